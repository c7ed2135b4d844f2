"""The lexical model of a corpus: lemma facts, vocabulary, surface forms, examples, terms.

Everything derives from one long fact table, (doc_id, lemma, form, position), so that maps
and lists are built only for the rows that are shown. Counts are two-level aggregates:
Spark adds up within a task first, and a frequent lemma is one row a document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import model, text
from quillspark.operators.packets import dealt
from quillspark.operators.search import near_pairs
from quillspark.operators.term_windows import head, run_counts

#: Terms that are cut together, and words whose first sentences a task holds.
PORTION, HELD = 100_000, 200_000
# white space as Spark's patterns know it
SENTENCE_END, SPACE, WORD = re.compile(r"(?<=[.!?])[ \t\n\v\f\r]+"), re.compile(r"[ \t\n\v\f\r]{2,}|[\t\n\v\f\r]"), re.compile(text.WORD)


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, pos, form, lemma of every word of two letters and more."""
    found = docs.select("doc_id", F.posexplode(text.words(F.col("text"))).alias("pos", "form"))
    return found.select("doc_id", "pos", "form", F.lower("form").alias("lemma")).where(F.length("lemma") >= text.LEMMA_LENGTH)


def lemma_counts(toks: DataFrame) -> DataFrame:
    return toks.groupBy("doc_id", "lemma").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(counts: DataFrame, docs: DataFrame) -> DataFrame:
    """Counts, rates and dispersion by lemma, over all documents, where support is enough.

    With three documents or more, a lemma needs 3 occurrences in 2 documents, else 2 in 1.
    """
    size = docs.agg(F.count(F.lit(1)).alias("_docs"))
    total = counts.agg(F.sum("n").alias("_tokens"))
    n = F.col("n").cast("double")
    by = counts.groupBy("lemma").agg(F.sum("n").alias("total_count"), F.count(F.lit(1)).alias("document_count"), F.sum(n * n).alias("_squares"))
    by = by.crossJoin(F.broadcast(size)).crossJoin(F.broadcast(total))  # one row each
    enough = F.when(F.col("_docs") >= 3, (F.col("total_count") >= 3) & (F.col("document_count") >= 2)).otherwise(F.col("total_count") >= 2)
    return by.where(enough).select(
        "lemma",
        "total_count",
        "document_count",
        F.round(F.col("document_count") / F.col("_docs"), 6).alias("document_share"),
        F.round(F.col("total_count") * 1e6 / F.col("_tokens"), 3).alias("frequency_per_million"),
        F.round(model.dispersion(F.col("total_count"), F.col("_squares"), F.col("_docs")), 6).alias("dispersion"),
    )


def surface_forms(toks: DataFrame, most: int = 8, key: str = "lemma") -> DataFrame:
    """The most frequent forms of each key, ties by first encounter."""
    forms = toks.groupBy(key, "form").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "pos")).alias("_first"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "_first"))
    return forms.withColumn("rank", rank).where(F.col("rank") <= most).select(key, "form", "n", "rank")


def modal_pos(toks: DataFrame) -> DataFrame:
    """Each lemma's most frequent part of speech, ties by first encounter."""
    tagged = toks.withColumn("pos_tag", text.part_of_speech(F.col("form")))
    tags = tagged.groupBy("lemma", "pos_tag").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "pos")).alias("_first"))
    best = tags.groupBy("lemma").agg(F.min(F.struct(-F.col("n"), "_first", "pos_tag")).alias("_best"))
    return best.select("lemma", F.col("_best.pos_tag").alias("part_of_speech"))


def examples(docs: DataFrame, most: int = 3, shortest: int = 35, longest: int = 500) -> DataFrame:
    """The first distinct sentences of fitting length that hold each lemma, in encounter order.

    Each task passes on the first sentences of its own documents alone: a sentence that is
    among the first of all is among the first where it was first met.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple]] = {}

        def flat() -> Iterator[pa.RecordBatch]:
            rows = [(w, place[1], place[2], s) for w, first in held.items() for place, s in first]
            held.clear()
            for i in range(0, len(rows), 10_000):
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 10_000], strict=True), types, strict=True)], names=["lemma", "doc_id", "sent", "sentence"])

        for batch in batches:
            types = (pa.string(), batch.column(0).type, pa.int32(), pa.string())
            for doc, whole in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for sent, piece in enumerate(SENTENCE_END.split(whole or "")):
                    s = SPACE.sub(" ", piece).strip(" ")
                    if not shortest <= len(s) <= longest:
                        continue
                    place = (doc is not None, doc, sent)
                    for w in {w.lower() for w in WORD.findall(s) if len(w) >= text.LEMMA_LENGTH}:
                        first = held.get(w)
                        if first is None:
                            held[w] = [(place, s)]
                        elif len(first) < most or place < first[-1][0]:
                            _met(first, place, s, most)
                if len(held) >= HELD:
                    yield from flat()
        if held:
            yield from flat()

    kind = docs.schema["doc_id"].dataType.simpleString()
    met = docs.select("doc_id", "text").mapInArrow(read, f"lemma string, doc_id {kind}, sent int, sentence string").repartition("lemma")
    again = F.row_number().over(Window.partitionBy("lemma", "sentence").orderBy("doc_id", "sent"))
    once = met.withColumn("_again", again).where("_again = 1").drop("_again")
    rank = F.row_number().over(Window.partitionBy("lemma").orderBy("doc_id", "sent"))
    return once.withColumn("rank", rank).where(F.col("rank") <= most).where("doc_id is not null").select("lemma", "rank", "doc_id", "sentence")


def _met(first: list[tuple], place: tuple, sentence: str, most: int) -> None:
    """Take up a sentence among the first of a word (place, sentence), each once, in order."""
    for i, (before, s) in enumerate(first):
        if s == sentence:
            if place >= before:
                return
            del first[i]
            break
    first.append((place, sentence))
    first.sort()
    del first[most:]


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: documents, words, exact median of words, documents of fewer than 100 words, the longest."""
    n = text.word_count(F.col("text"))
    return docs.select(n.cast("long").alias("n")).agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum("n").alias("words"),
        F.percentile("n", F.lit(0.5)).alias("median_words"),
        F.count_if(F.col("n") < 100).alias("low_extraction"),
        F.max("n").alias("longest"),
    )


def runs(words: str, k: int) -> Column:
    """All runs of k neighbours of an array of words, joined by a space."""
    made = F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))
    return F.when(F.size(words) >= k, made).otherwise(F.array().cast("array<string>"))


def ngrams(docs: DataFrame, low: int = 2, high: int = 6, stop: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, line, size, form, term of word n-grams within lines that neither start nor end in a stop word."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "_l"))
    lines = lines.select("doc_id", "line", text.words(F.col("_l")).alias("_w"))
    some = [runs("_w", k) for k in range(low, high + 1)]
    grams = lines.select("doc_id", "line", F.explode(F.concat(*some)).alias("_g"))
    grams = grams.select("doc_id", "line", F.size(F.split("_g", " ")).alias("size"), F.col("_g").alias("form"), F.lower("_g").alias("term"))
    ends = F.split("term", " ")
    ok = ~F.element_at(ends, 1).isin(*stop) & ~F.element_at(ends, -1).isin(*stop) if stop else F.lit(True)
    return grams.where(ok & (F.length("term") >= 5))


def term_counts(grams: DataFrame, documents: int) -> DataFrame:
    """Terms with two occurrences or more, in two documents where the corpus has three."""
    per = grams.groupBy("doc_id", "term", "size").agg(F.count(F.lit(1)).alias("n"))
    by = per.groupBy("term", "size").agg(F.sum("n").alias("total_count"), F.count(F.lit(1)).alias("document_count"))
    return by.where((F.col("total_count") >= 2) & (F.col("document_count") >= (2 if documents >= 3 else 1)))


def corpus_terms(docs: DataFrame, low: int = 2, high: int = 6, stop: tuple[str, ...] = ()) -> DataFrame:
    """term, size, total_count, document_count, documents (of the corpus): term_counts() of all n-grams, in one exchange of a window a place."""
    size = docs.agg(F.count(F.lit(1)).alias("documents"))
    out = run_counts(docs, low, high, stop).crossJoin(F.broadcast(size))  # one row
    return out.where((F.col("documents") < 3) | (F.col("document_count") >= 2))


def _parts(terms: pa.Table, stop: pa.Array) -> pa.Table:
    """Parts of two to five words of longer terms (term, total_count, size) that neither start nor end in a stop word: the sum of their terms' counts, and their places."""
    words = pc.split_pattern(terms["term"].combine_chunks(), " ")
    at, flat = words.offsets.to_numpy().astype(np.int64), words.flatten()
    at, n = at[:-1] - at[0], np.diff(at)
    size, f = terms["size"].to_numpy(), terms["total_count"].to_numpy()
    fits = ~pc.is_in(flat, stop).to_numpy(zero_copy_only=False)
    made = []
    for k in range(2, 6):
        for i in range(int(n.max(initial=0)) - k + 1):
            own = np.flatnonzero((size > k) & (n >= i + k))
            own = own[fits[at[own] + i] & fits[at[own] + i + k - 1]]
            part = pc.binary_join_element_wise(*(flat.take(pa.array(at[own] + i + j)) for j in range(k)), " ")
            made.append(pa.table({"term": part, "f": f[own]}))
    return pa.concat_tables(made).group_by("term").aggregate([("f", "sum"), ("f", "count")]) if made else pa.table({"term": pa.array([], pa.string()), "f_sum": pa.array([], pa.int64()), "f_count": pa.array([], pa.int64())})


def _met_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms of sorted rows (term, its counts and size, or sum and places of the terms around it) with the mean count of those around."""
    held: pa.RecordBatch | None = None

    def added(rows: pa.RecordBatch) -> pa.RecordBatch:
        term = rows.column(0)
        starts = np.flatnonzero(np.r_[True, pc.not_equal(term.slice(1), term.slice(0, len(term) - 1)).to_numpy(zero_copy_only=False)])
        whole = [pc.fill_null(c, 0).to_numpy() for c in rows.columns[1:]]
        sums = [f.reduceat(c, starts) for f, c in zip([np.maximum] * 3 + [np.add] * 2, whole, strict=True)]
        return pa.record_batch([term.take(pa.array(starts)), *(pa.array(c) for c in sums)], names=rows.schema.names)

    def told(rows: pa.RecordBatch) -> pa.RecordBatch:
        rows = rows.filter(pc.greater(rows.column(3), 0))
        places = rows.column(5).to_numpy()
        mean = pa.array(rows.column(4).to_numpy() / np.maximum(places, 1), mask=places == 0)
        return pa.record_batch([*rows.columns[:4], mean], names=[*rows.schema.names[:4], "_around"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = added(batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0])
        held = rows.slice(rows.num_rows - 1)
        yield told(rows.slice(0, rows.num_rows - 1))
    if held is not None:
        yield told(held)


def c_values(terms: DataFrame, stop: tuple[str, ...] = ()) -> DataFrame:
    """C-value: log2 of a term's length times its count less the mean count of the terms around it.

    A term counts once for every place where it stands within a longer one. Longer terms are
    cut into their parts, whose counts are added up where they are cut, and terms and parts
    meet in one exchange. With `stop`, parts that start or end in such a word are no terms and
    are not cut. Each term is one row.
    """
    ends = pa.array(sorted(stop), pa.string())
    names = ["term", "total_count", "document_count", "size", "around", "places"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def summed() -> pa.RecordBatch:
            own = pa.Table.from_batches(held)
            found = _parts(own, ends)
            none = [pa.nulls(n, pa.int64()) for n in (len(own), len(found))]
            both = pa.concat_tables([pa.table([*own.columns, none[0], none[0]], names=names), pa.table([found["term"], *[none[1]] * 3, found["f_sum"], found["f_count"]], names=names)])
            held.clear()
            return both.sort_by("term").combine_chunks().to_batches()[0]

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= PORTION:
                yield summed()
        if held:
            yield summed()

    own = terms.select("term", *(F.col(c).cast("long").alias(c) for c in names[1:4]))
    both = dealt(own, cut, lambda rows: head(rows.column(0), 2), "term string, total_count long, document_count long, size long, around long, places long")
    by = both.sortWithinPartitions("term").mapInArrow(_met_parts, "term string, total_count long, document_count long, size long, _around double")
    value = F.log2(F.col("size").cast("double")) * (F.col("total_count") - F.coalesce("_around", F.lit(0.0)))
    return by.select("term", "total_count", "document_count", F.round(F.greatest(F.lit(0.0), value), 6).alias("c_value"))


def shared_terms(terms: DataFrame, share: float = 0.10) -> DataFrame:
    """Terms that stand in a share of all documents (documents), at least in one."""
    least = F.greatest(F.lit(1), F.ceil(F.round(F.col("documents") * share, 6)))
    return terms.where(F.col("document_count") >= least)


def acronyms(docs: DataFrame) -> DataFrame:
    """Counts of "expansion (ACRONYM)" by acronym and lower-case expansion."""
    found = docs.select(F.explode(F.regexp_extract_all("text", F.lit(text.ACRONYM), F.lit(0))).alias("_m"))
    found = found.select(F.regexp_extract("_m", text.ACRONYM, 1).alias("_e"), F.regexp_extract("_m", text.ACRONYM, 2).alias("acronym"))
    return found.select("acronym", F.lower(text.squeezed(F.col("_e"))).alias("expansion")).groupBy("acronym", "expansion").agg(F.count(F.lit(1)).alias("n"))


def acronym_expansions(counts: DataFrame) -> DataFrame:
    """Sorted expansions of each acronym; a plural goes where its singular stands."""
    own = counts.select(F.lower("acronym").alias("acronym"), "expansion").distinct()
    singular = own.select("acronym", F.concat("expansion", F.lit("s")).alias("expansion"))
    kept = own.join(singular, ["acronym", "expansion"], "left_anti")
    return kept.groupBy("acronym").agg(F.array_join(F.array_sort(F.collect_set("expansion")), "|").alias("expansions"))


def acronym_dominance(toks: DataFrame) -> DataFrame:
    """Lemmas whose forms are capitals twice or more and in half their occurrences."""
    upper = F.count_if(F.col("form").rlike("^[A-Z][A-Z0-9]+s?$")).alias("uppercase_count")
    by = toks.groupBy("lemma").agg(upper, F.count(F.lit(1)).alias("observed_count"))
    return by.where((F.col("uppercase_count") >= 2) & (F.col("uppercase_count") * 2 >= F.col("observed_count")))


def orthography_queue(vocab: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Vocabulary that a spelling lexicon (term) lacks."""
    return vocab.join(lexicon.select(F.col("term").alias("lemma")).distinct(), "lemma", "left_anti")


def spelling_suggestions(words: DataFrame, lexicon: DataFrame, distance: int = 2, most: int = 5) -> DataFrame:
    """Lexicon terms (term, frequency) within an edit distance of each lemma, nearest and most frequent first.

    Words and terms meet where variants of both with letters deleted are the same (Garbe's
    symmetric deletes), long ones by their pieces; the distance is then worked out. So no
    lemma meets the whole lexicon, and a lemma longer than its longest term by more than the
    distance meets none.
    """
    near = near_pairs(lexicon, "term", words, "lemma", distance).join(lexicon.select("term", "frequency"), "term").select("lemma", "term", "frequency")
    near = near.withColumn("edit_distance", F.levenshtein("lemma", "term"))
    rank = F.row_number().over(Window.partitionBy("lemma").orderBy("edit_distance", F.desc("frequency"), "term"))
    return near.withColumn("rank", rank).where(F.col("rank") <= most)


def merged_counts(counts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Fact counts after decisions (lemma, action, target): replaced lemmas count as their target, dropped ones not."""
    named = counts.join(decisions, "lemma", "left").where("action is null or action <> 'drop'")
    lemma = F.when(F.col("action") == "replace", F.col("target")).otherwise(F.col("lemma")).alias("lemma")
    return named.select("doc_id", lemma, "n").groupBy("doc_id", "lemma").agg(F.sum("n").alias("n"))
