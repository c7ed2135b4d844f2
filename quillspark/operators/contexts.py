"""Where terms stand in whole texts: contexts between sentence marks, windows around words, and terms with their sources.

Terms meet sentences by all their words in a row, an equality of hashes of 64 bits; the phrase
itself is then looked for in that sentence only. So no term is held against every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pandas.util import hash_array
from pyarrow import fs as pafs
from pyarrow import parquet
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillspark.functions import text
from quillspark.shared import written
from quillspark.sources.recorded import opened

# Letters on either side of a term between sentence marks, and those of a window.
REACH, WINDOW, EDGE = 420, 500, 80
# White space as Spark's patterns know it; rows that a task passes on together.
SENTENCE_END, SPACE, LETTERS = re.compile(r"(?<=[.!?])[ \t\n\v\f\r]+"), re.compile(r"[ \t\n\v\f\r]{2,}|[\t\n\v\f\r]"), re.compile("[A-Za-z]+")
ROWS = 5_000
# A sentence with its mark, runs of white space, words of any script; letters of texts that are held against the forms together.
SAID, BLANK, WORDS = re.compile(r"[^.!?]*[.!?]"), re.compile(r"[ \t\n\v\f\r]+"), re.compile(r"\w+")
PORTION, FACTOR = 4_000_000, np.uint64(0x9E3779B97F4A7C15)

Batches = Iterator[pa.RecordBatch]


def _keys(words: list[list[str]], sizes: list[int]) -> tuple[np.ndarray, ...]:
    """Hashes of the runs of these many words in lists of words, with the list, first word and size of each."""
    count = np.array([len(w) for w in words], np.int64)
    flat = pa.array([x for w in words for x in w], pa.string()).dictionary_encode()
    code = hash_array(np.array(flat.dictionary.to_pylist(), dtype=object), categorize=False)[flat.indices.to_numpy(zero_copy_only=False)]
    own = np.repeat(np.arange(len(words)), count)
    place = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    out, run = [], np.zeros(len(code), np.uint64)
    for k in range(1, max(sizes, default=0) + 1):
        run = run[: len(code) - k + 1] * FACTOR + code[k - 1 :] if len(code) >= k else run[:0]
        if k in sizes:
            fit = np.flatnonzero(place[: len(run)] + k <= count[own[: len(run)]])
            out.append((run[fit], own[fit], place[fit], np.full(len(fit), k)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)


def _forms(batches: Batches) -> Batches:
    """key, size and form of forms (term, form, rank); those that are their words with a space between are told by their words alone (null)."""
    for batch in batches:
        term, form, rank = (c.to_pylist() for c in batch.columns)
        words = [WORDS.findall(f.lower()) for f in form]
        rows = [(w, None, None, None) if t == f == " ".join(w) and r == 0 else (w, t, f, r) for w, t, f, r in zip(words, term, form, rank, strict=True) if w]
        if rows:
            cols = [pa.array(_whole([r[0] for r in rows]).view(np.int64)), pa.array([len(r[0]) for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], t) for i, t in ((1, pa.string()), (2, pa.string()), (3, pa.int32())))]
            yield pa.record_batch(cols, names=["key", "size", "term", "form", "rank"])


def _whole(words: list[list[str]]) -> np.ndarray:
    """The hash of each list of words."""
    sizes = sorted({len(w) for w in words})
    key, own, place, size = _keys(words, sizes)
    out = np.zeros(len(words), np.uint64)
    whole = (place == 0) & (size == np.array([len(w) for w in words])[own])
    out[own[whole]] = key[whole]
    return out


class _Sentence:
    """A sentence with the spans of its words."""

    def __init__(self, text: str):
        self.text, self.low = text, text.lower()
        self.even = len(self.low) == len(text)
        self.spans = [m.span() for m in WORDS.finditer(self.low)] if self.even else []
        self.words = [self.low[a:b] for a, b in self.spans] if self.even else WORDS.findall(self.low)

    def context(self, form: str, runs: list[int]) -> str | None:
        """The part around the first place of a form, where its words are from word `runs` on, that has the end in reach: up to REACH letters before it, and all after it."""
        n, size = len(self.text), len(form)
        least = max(0, n - 1 - REACH - size)
        if self.even:
            ahead = WORDS.search(form).start()
            places = (self.spans[i][0] - ahead for i in runs)
            fits = lambda at: at >= least and self.low.startswith(form, at) and not WORDS.match(self.low[max(0, at - 1) : at]) and not WORDS.match(self.low[at + size : at + size + 1])
            place = next((at for at in places if fits(at)), None)
        else:
            found = re.compile(rf"(?<!\w){re.escape(form)}(?!\w)", re.I).search(self.text, least)
            place = found and found.start()
        return None if place is None else self.text[max(0, place - REACH) :].strip(" ")


def term_contexts(docs: DataFrame, forms: DataFrame) -> DataFrame:
    """The longest context of each term in each document that has one: doc_id, term, context.

    forms (term, form, rank) are the ways a term is written; those of no letter or with a
    sentence mark have no context. Of equally long contexts that of the lower rank, then the
    earlier sentence. Texts are dealt out once. What tells a form by its words, a hash, is in
    files of the shared folder, which a task reads one by one for the texts that it holds; so
    neither runs of words nor contexts are dealt out.
    """
    asked = forms.where(~F.col("form").rlike("[.!?]")).select("term", F.trim("form").alias("form"), "rank")
    made = written(asked.mapInArrow(_forms, "key long, size int, term string, form string, rank int").sortWithinPartitions("key"), "forms")
    sizes = [r[0] for r in made.select("size").distinct().collect()]  # few: words of a form
    folder, kind = made.written_to, to_arrow_type(docs.schema["doc_id"].dataType)

    def told(held: list[tuple]) -> Batches:
        """Rows of documents (doc_id, texts)."""
        said = [(d, i, _Sentence(x)) for d, (_, texts) in enumerate(held) for t in texts for i, x in enumerate(SAID.findall(BLANK.sub(" ", t or "")))]
        key, own, place, size = _keys([x.words for _, _, x in said], sizes)
        distinct, group = np.unique(key, return_inverse=True)
        plain, others = np.zeros(len(distinct), bool), {}
        for names, form in _found(folder, distinct):
            plain[names[form.column(0).is_null().to_numpy(zero_copy_only=False)]] = True
            some = form.filter(form.column(0).is_valid())
            for g, *x in zip(names[form.column(0).is_valid().to_numpy(zero_copy_only=False)].tolist(), *(c.to_pylist() for c in some.columns), strict=True):
                others.setdefault(g, []).append(x)
        hit = plain.copy()
        hit[list(others)] = True
        rows = np.flatnonzero(hit[group])
        rows = rows[np.lexsort((place[rows], group[rows], own[rows]))]
        best: dict[tuple, tuple] = {}
        at = rows.tolist()
        for (s, g), runs in groupby(at, key=lambda i: (own[i], group[i])):
            runs = list(runs)
            d, sent, sentence = said[s]
            first = [int(place[i]) for i in runs]
            words = " ".join(sentence.words[first[0] : first[0] + int(size[runs[0]])]) if plain[g] else None
            for term, form, rank in [*([(words, words, 0)] if plain[g] else []), *others.get(int(g), [])]:
                context = sentence.context(form.lower(), first)
                if context is not None:
                    new = (len(context), -rank, -sent, context)
                    if (old := best.get((d, term))) is None or new > old:
                        best[d, term] = new
        got = list(best.items())
        for i in range(0, len(got), ROWS):
            part = got[i : i + ROWS]
            yield pa.record_batch([pa.array([held[d][0] for (d, _), _ in part], kind), pa.array([t for (_, t), _ in part]), pa.array([x[3] for _, x in part])], names=["doc_id", "term", "context"])

    def read(batches: Batches) -> Batches:
        held, letters = [], 0
        for batch in batches:
            for doc, whole in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[-1][0] == doc:  # a document in several rows
                    held[-1][1].append(whole)
                else:
                    if letters >= PORTION:
                        yield from told(held)
                        held, letters = [], 0
                    held.append((doc, [whole]))
                letters += len(whole or "")
        if held:
            yield from told(held)

    own = docs.where("doc_id is not null").select("doc_id", "text").repartition("doc_id").sortWithinPartitions("doc_id")
    return own.mapInArrow(read, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, term string, context string")


def _found(folder: str, keys: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """Forms (term, form, rank) of files whose key is one of some sorted keys, and the places of theirs."""
    fs, path = opened(folder)
    for f in fs.get_file_info(pafs.FileSelector(path)):
        if f.path.endswith(".parquet") and len(keys):
            with parquet.ParquetFile(f.path, filesystem=fs) as file:
                for batch in file.iter_batches(1 << 20):
                    own = batch.column(0).to_numpy().view(np.uint64)
                    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    met = np.flatnonzero(keys[at] == own)
                    yield at[met], pa.Table.from_batches([batch.select(["term", "form", "rank"])]).take(pa.array(met))


def window(sentence: Column, start: Column, end: Column, limit: int = WINDOW) -> Column:
    """A sentence, or some `limit` letters of it around its letters start to end (from 0), cut at spaces near the cuts, with … where it is cut."""
    n = F.length(sentence)
    begun = F.greatest(F.lit(0), F.floor((start + end) / 2).cast("int") - limit // 2)
    right = F.least(n, begun + limit)
    left = F.greatest(F.lit(0), right - limit)
    ahead = F.instr(F.substring(sentence, left + 1, F.greatest(F.lit(0), F.least(start, left + EDGE) - left)), " ")
    first = F.when((left > 0) & (ahead > 0), left + ahead).otherwise(left)
    low = F.greatest(end, right - EDGE)
    behind = F.substring(sentence, low + 1, F.greatest(F.lit(0), right - low))
    back = F.instr(F.reverse(behind), " ")
    space = low + F.length(behind) - back
    last = F.when((right < n) & (back > 0) & (space > end), space).otherwise(right)
    cut = text.squeezed(F.substring(sentence, first + 1, F.greatest(F.lit(0), last - first)))
    out = F.concat(F.when(first > 0, "… ").otherwise(""), cut, F.when(last < n, " …").otherwise(""))
    return F.when(n <= limit, text.squeezed(sentence)).otherwise(out)


def window_of(sentence: str, start: int, end: int, limit: int = WINDOW) -> str:
    """window() of one sentence in a task that holds it."""
    n = len(sentence)
    if n <= limit:
        return SPACE.sub(" ", sentence).strip(" ")
    right = min(n, max(0, (start + end) // 2 - limit // 2) + limit)
    left = max(0, right - limit)
    ahead = sentence.find(" ", left, max(left, min(start, left + EDGE)))
    first = ahead + 1 if left > 0 and ahead >= 0 else left
    low = max(end, right - EDGE)
    back = sentence.rfind(" ", low, max(low, right))
    last = back if right < n and back > end else right
    cut = SPACE.sub(" ", sentence[first:last]).strip(" ")
    return ("… " if first > 0 else "") + cut + (" …" if last < n else "")


def _places(texts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, lemma, n, place: how often each word stands in a text, and its first place, a sentence (of 2^32) and a word's number in it."""
    for batch in texts:
        rows: list[tuple] = []
        for doc, whole in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            count: dict[str, list[int]] = {}
            for sent, sentence in enumerate(SENTENCE_END.split(whole or "")):
                for place, w in enumerate(LETTERS.findall(sentence), sent << 32):
                    w = w.lower()
                    if (held := count.get(w)) is None:
                        count[w] = [1, place]
                    else:
                        held[0] += 1
            rows += ((doc, w, n, place) for w, (n, place) in count.items())
            if len(rows) >= ROWS:
                yield _batch(rows, batch.column(0).type)
                rows = []
        if rows:
            yield _batch(rows, batch.column(0).type)


def _batch(rows: list[tuple], key: pa.DataType) -> pa.RecordBatch:
    types = (key, pa.string(), pa.int64(), pa.int64() if isinstance(rows[0][3], int) else pa.string())
    names = ["doc_id", "lemma", "n", "place" if types[3] == pa.int64() else "context"]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _shown(texts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, lemma, n, context of texts (doc_id, text, words of lemma, n, place)."""
    for batch in texts:
        rows: list[tuple] = []
        lists = batch.column(2)
        flat, ends = lists.flatten(), lists.offsets.to_pylist()
        words = list(zip(*(flat.field(c).to_pylist() for c in ("place", "lemma", "n")), strict=True))
        for i, (doc, whole) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            said = SENTENCE_END.split(whole or "")
            sent, spans, short = -1, [], None
            for place, lemma, n in sorted(words[ends[i] - ends[0] : ends[i + 1] - ends[0]]):
                if place >> 32 != sent:
                    sent = place >> 32
                    sentence = said[sent] if sent < len(said) else ""
                    spans = [m.span() for m in LETTERS.finditer(sentence)]
                    short = window_of(sentence, 0, 0) if len(sentence) <= WINDOW else None
                k = place & 0xFFFFFFFF
                if k < len(spans):  # another text of the same doc_id may lack the place
                    rows.append((doc, lemma, n, window_of(sentence, *spans[k]) if short is None else short))
                if len(rows) >= ROWS:
                    yield _batch(rows, batch.column(0).type)
                    rows = []
        if rows:
            yield _batch(rows, batch.column(0).type)


def word_contexts(docs: DataFrame, words: DataFrame, most: int | None = None) -> DataFrame:
    """How often each word (lemma) stands in each document, and a window around its first place: doc_id, lemma, n, context.

    Sentences end after . ! ? and white space. With `most` the most frequent words of a
    document stay, ties by their first place. Words are counted where a document is read; those
    that are asked for come back to it by its id, a list a document, and windows are cut there.
    """
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.mapInArrow(_places, f"doc_id {kind}, lemma string, n long, place long")
    own = found.join(words.select("lemma").distinct().hint("shuffle_hash"), "lemma", "left_semi").repartition("doc_id")
    by = own.groupBy("doc_id", "lemma").agg(F.sum("n").alias("n"), F.min("place").alias("place"))
    if most is not None:
        rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "place"))
        by = by.withColumn("_r", rank).where(F.col("_r") <= most)
    lists = by.groupBy("doc_id").agg(F.collect_list(F.struct("lemma", "n", "place")).alias("words"))
    return docs.join(lists, "doc_id").select("doc_id", "text", "words").mapInArrow(_shown, f"doc_id {kind}, lemma string, n long, context string")


def term_rows(terms: DataFrame, contexts: DataFrame, explanations: DataFrame, papers: DataFrame, statuses: DataFrame) -> DataFrame:
    """Terms as a catalogue shows them for each source: rows (term, total_count, document_count) joined with what is known of them.

    contexts (doc_id, term, context); explanations (term, meaning_en, meaning_zh,
    concept_role, sense_key), matched in lower case; papers (doc_id, title, url); statuses
    (item_id, status), absent: new. A term without a whole explanation is left out.
    """
    whole = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    told = explanations.where(whole("meaning_en") & whole("meaning_zh") & whole("concept_role")).select(F.lower("term").alias("_t"), "meaning_en", "meaning_zh", "concept_role", "sense_key")
    out = terms.join(told, F.lower("term") == F.col("_t")).join(contexts, "term").join(papers, "doc_id")
    sense = F.coalesce(F.nullif(F.trim("sense_key"), F.lit("")), F.lower("term"))
    out = out.withColumn("sense_key", sense).withColumn("item_id", text.stable_id(F.lit("term"), F.lower(text.squeezed(F.col("term"))), F.col("sense_key")))
    out = out.join(statuses.select("item_id", "status"), "item_id", "left").withColumn("status", F.coalesce("status", F.lit("new")))
    return out.withColumn("evidence_context_id", text.stable_id(F.col("doc_id").cast("string"), F.col("context"), length=24)).drop("_t")


def terms_of_paper(terms: DataFrame, doc_id) -> DataFrame:
    """Terms (term, source_papers) whose sources have a document."""
    return terms.where(F.array_contains("source_papers", doc_id))


def with_sources(terms: DataFrame, contexts: DataFrame) -> DataFrame:
    """Terms with source_papers, the sorted documents they have contexts in."""
    by = contexts.groupBy("term").agg(F.sort_array(F.collect_set("doc_id")).alias("source_papers"))
    return terms.join(by, "term")
