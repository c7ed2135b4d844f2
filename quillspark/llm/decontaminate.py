"""Benchmark passages in training documents, by an FM-index of each shard of documents.

A shard is some 400,000 words of documents, interned as numbers, with a number of its own
after each text. Its suffix array comes from sorting the first three numbers of each suffix
and then doubling that length for those that are still equal (Larsson and Sadakane 2007).
The last column of the sorted rotations is kept as a wavelet tree in matrix form (Claude,
Navarro and Ordonez 2015): a bit a level and word, with counts of ones. Ranks in it step a
phrase's range of suffixes back by a word (backward search, Ferragina and Manzini 2000),
for all phrases in a few numpy operations; a suffix of the range walks back to the next
sampled position, which gives the place. Places of a document are merged to spans.

Phrases are windows of benchmark items, in files of bounded size in the shared folder, which
tasks read one by one: neither side needs to fit in memory, and documents are not shuffled.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import numbers, portions, ragged, rows, word_lists
from quillspark.llm.token_files import got, put
from quillspark.shared import deleted, dropped, new_path, written

SHARD, PHRASES, SAMPLE = 400_000, 100_000, 16
#: Bytes of texts that are held together, unless one text has more.
TOGETHER = 3_000_000
#: Places that are walked back together.
WALKS = 1_000_000
#: A word is a run of these bytes of lower-cased UTF-8: digits, letters, all beyond ASCII.
IN_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Bytes to those of words: A-Z lowered, others blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if IN_WORD.match(bytes([b])) else 32 for b in range(256))


def folded(texts: pa.Array) -> pa.Array:
    """Texts with A-Z lowered and blanks for all bytes that stand in no word."""
    n, (_, at, body), first = len(texts), texts.buffers(), texts.offset
    if body is None:
        return texts
    at = np.frombuffer(at, np.int32)[first : first + n + 1]
    body = pa.py_buffer(body[int(at[0]) : int(at[-1])].to_pybytes().translate(FOLD))
    return pa.StringArray.from_buffers(n, pa.py_buffer((at - at[0]).astype(np.int32)), body, texts.is_valid().buffers()[1])


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


def suffix_order(x: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of x, sorted. Its last number must stand nowhere else."""
    n = len(x)
    padded = np.concatenate((x.astype(np.int64) + 1, np.zeros(2, np.int64)))
    key = (padded[:n] << 42) | (padded[1 : n + 1] << 21) | padded[2:]
    order = np.argsort(key, kind="stable")
    rank, known = np.empty(n, np.int64), key[order]
    first = np.concatenate(([True], known[1:] != known[:-1]))
    at = np.flatnonzero(first)
    rank[order] = np.repeat(at, np.diff(np.append(at, n)))  # of the group's first place
    alone = first & np.append(first[1:], True)
    open_, length = np.flatnonzero(~alone), 3
    while len(open_):
        some = order[open_]
        later = some + length
        beyond = np.where(later < n, rank[np.minimum(later, n - 1)] + 1, 0)
        by = np.lexsort((beyond, rank[some]))
        some, beyond, group = some[by], beyond[by], rank[some[by]]
        order[open_] = some
        first = np.ones(len(open_), bool)
        first[1:] = (group[1:] != group[:-1]) | (beyond[1:] != beyond[:-1])
        at = np.flatnonzero(first)
        rank[some] = np.repeat(open_[at], np.diff(np.append(at, len(open_))))
        alone = first & np.append(first[1:], True)
        open_, length = open_[~alone], 2 * length
    return order


class Wavelet:
    """Ranks of numbers in a sequence: at each level, from the highest bit on, those with a zero go before those with a one."""

    def __init__(self, x: np.ndarray):
        self.bits = max(1, int(x.max(initial=0)).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (x >> level) & 1
            self.ones.append(np.concatenate((np.zeros(1, np.int32), np.cumsum(bit, dtype=np.int32))))
            one = bit.astype(bool)
            self.zeros.append(len(x) - int(self.ones[-1][-1]))
            x = np.concatenate((x[~one], x[one]))
        self.begin = self.below(np.arange(1 << self.bits), 0)

    def below(self, c: np.ndarray, at: np.ndarray | int) -> np.ndarray:
        """Where the numbers c before place `at` end in the last level."""
        at = np.broadcast_to(np.asarray(at, np.int64), c.shape)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            one = ones[at]
            at = np.where((c >> (self.bits - 1 - k)) & 1, zeros + one, at - one)
        return at

    def rank(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many of the numbers before each place are c."""
        return self.below(c, at) - self.begin[c]

    def ranked(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number c at each place, and how many before it are c."""
        c = np.zeros(len(at), np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            one = ones[at]
            bit = ones[at + 1] - one
            at = np.where(bit, zeros + one, at - one)
            c = 2 * c + bit
        return c, at - self.begin[c]


class FMIndex:
    """A sequence of numbers, whose last stands nowhere else, for search by phrases."""

    def __init__(self, x: np.ndarray):
        order = suffix_order(x)
        self.tree = Wavelet(x[order - 1])
        self.first = np.concatenate(([0], np.cumsum(np.bincount(x, minlength=1 << self.tree.bits))))
        sampled = order % SAMPLE == 0
        self.marks = np.concatenate((np.zeros(1, np.int32), np.cumsum(sampled, dtype=np.int32)))
        self.places = order[sampled]

    def ranges(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and stop of the suffixes that begin with each phrase, a row of numbers that the sequence holds."""
        last = phrases[:, -1]
        first, stop, live = self.first[last], self.first[last + 1], np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.zeros(len(phrases), np.int64)
        for k in range(phrases.shape[1] - 2, -1, -1):
            c = phrases[live, k]
            first, stop = (self.first[c] + self.tree.rank(c, at) for at in (first, stop))
            some = first < stop
            first, stop, live = first[some], stop[some], live[some]
        low[live], high[live] = first, stop
        return low, high

    def located(self, at: np.ndarray) -> np.ndarray:
        """Where in the sequence the suffixes of these places in their order begin."""
        out, left, steps = np.zeros(len(at), np.int64), np.arange(len(at)), 0
        at = at.copy()
        while len(left):
            held = self.marks[at + 1] > self.marks[at]
            out[left[held]] = self.places[self.marks[at[held]]] + steps
            left, at, steps = left[~held], at[~held], steps + 1
            c, rank = self.tree.ranked(at)
            at = self.first[c] + rank
        return out


def saved(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def phrase_file(windows: list[list[bytes]], ids: list[str | None]) -> bytes:
    """A file of windows of one item each: distinct windows as rows of word numbers (-1: shorter), their words, and the items of each."""
    table, distinct = {}, {}
    which = np.array([distinct.setdefault(tuple(table.setdefault(x, len(table)) for x in w), len(distinct)) for w in windows])
    most = max(map(len, windows))
    items, item = np.unique(np.array([("", "n")[x is None] + (x or "") if x is None else "s" + x for x in ids]), return_inverse=True)
    pairs = np.unique(np.stack((which, item), 1), axis=0)
    return saved(
        phrases=np.array([[-1] * (most - len(w)) + list(w) for w in distinct], np.int32),
        words=np.frombuffer(b" ".join(table), np.uint8),
        items=items,
        starts=np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1)),
        item=pairs[:, 1],
    )


def written_phrases(benchmark: DataFrame, folder: str, window: int) -> DataFrame:
    """Files of the windows of benchmark items (item_id, text), and a written table of their names (file)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, ids, made = [], [], 0

        def file() -> pa.RecordBatch:
            name = f"phrases-{TaskContext.get().partitionId():06d}-{made:06d}.npz"
            put(folder, name, phrase_file(windows, ids))
            return pa.record_batch([[name]], names=["file"])

        for names, texts in rows(batches, "item_id", "text", step=64):
            for item, text in zip(names, texts, strict=True):
                own = words_of(text)
                for at in range(max(1, len(own) - window + 1) if own else 0):
                    windows.append(own[at : at + window])
                    ids.append(item)
                    if len(windows) >= PHRASES:
                        yield file()
                        windows, ids, made = [], [], made + 1
        if windows:
            yield file()

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return written(items.repartition(1 + size // (6 * PHRASES)).mapInArrow(run, "file string"), "phrases")


@lru_cache(maxsize=4)
def phrases_of(folder: str, name: str) -> tuple:
    a = np.load(io.BytesIO(got(folder, name)), allow_pickle=False)
    return a["phrases"], pa.array(a["words"].tobytes().decode().split(" ")), a["items"], a["starts"], a["item"]


class Shard:
    """Neighbouring words of documents with their index, searched by files of phrases."""

    def __init__(self, words: pa.Array, doc: np.ndarray):
        """doc: the document of each word, ascending."""
        own, self.known = numbers(words)
        between = np.concatenate(([0], np.cumsum(np.diff(doc) > 0)))
        at = np.arange(len(own)) + between
        x = np.full(len(own) + int(between[-1]) + 1, -1, np.int64)
        self.word = np.cumsum(np.bincount(at, minlength=len(x))) - 1  # of each place
        x[at] = own
        x[x < 0] = len(self.known) + np.arange(int(between[-1]) + 1)
        self.index = FMIndex(x)

    def hits(self, folder: str, name: str) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Of a file's phrases of each length: the words where they start, the phrases there, and the length."""
        phrases, words, *_ = phrases_of(folder, name)
        known = np.append(pc.index_in(words, value_set=self.known).fill_null(-1).to_numpy(), -1).astype(np.int64)
        skip = (phrases < 0).sum(1)
        for k in np.unique(skip).tolist():
            which = np.flatnonzero(skip == k)
            own = known[phrases[which, k:]]
            some = (own >= 0).all(1)
            which = which[some]
            if not len(which):
                continue
            first, stop = self.index.ranges(own[some])
            bounds = np.concatenate(([0], np.cumsum(stop - first)))
            for start in range(0, int(bounds[-1]), WALKS):
                flat = np.arange(start, min(start + WALKS, int(bounds[-1])))
                of = np.searchsorted(bounds, flat, "right") - 1
                yield self.word[self.index.located(first[of] + flat - bounds[of])], which[of], phrases.shape[1] - k


def merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint spans of the same places, neighbours joined, in order."""
    by = np.argsort(start, kind="stable")
    start, stop = start[by], np.maximum.accumulate(stop[by])
    first = np.ones(len(start), bool)
    first[1:] = start[1:] > stop[:-1]
    return start[first], stop[np.append(np.flatnonzero(first)[1:] - 1, len(stop) - 1)]


def split(start: np.ndarray, stop: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans cut where a document begins."""
    inner = begin[np.searchsorted(start, begin, "left") > np.searchsorted(stop, begin, "right")]
    return np.sort(np.concatenate((start, inner))), np.sort(np.concatenate((stop, inner)))


def without(text: str, spans: list[dict]) -> str:
    """A text less its words of these spans and what stands between them."""
    raw, kept, done = text.encode(), [], 0
    at = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(FOLD))]
    for x in spans:
        kept.append(raw[done : at[x["start"]][0]])
        done = at[x["start"] + x["length"] - 1][1]
    return b"".join([*kept, raw[done:]]).decode()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, shard: int = SHARD, with_text: bool = False) -> DataFrame:
    """Where windows of benchmark items (item_id, text) occur in whole documents (doc_id, text).

    Words are runs `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lowered. A window is
    `window` neighbouring words of an item, or all words of a shorter one. Returns a row per
    document: doc_id, n_words, spans (array of start, length in words, disjoint, in order:
    what to remove) and items (their ids as strings, sorted, each once); with_text adds
    clean_text, the text without those spans (null for a null text). Null and empty texts
    have no words; items without a word or of one text have no window or the same ones; a
    null item_id gives spans, but no id. Shards overlap by window - 1
    words, so that a long document may lie in several. Null and repeated doc_ids are documents each; other
    columns are ignored; an empty table gives no row, an empty benchmark no span.
    """
    spark = docs.sparkSession
    folder = new_path(spark, "decontaminate")
    manifest = written_phrases(benchmark, folder, window)
    files = sorted(r.file for r in manifest.collect())  # a name for each 100,000 windows
    dropped(manifest)
    ids = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_words", "spans", "items"] + ["clean_text"] * with_text

    def searched(texts: pa.Array) -> list[pa.Array]:
        flat, n = word_lists(folded(texts))
        doc, begin = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
        spans, held = [], {}
        for at in range(0, len(flat), shard):
            to = min(at + shard + window - 1, len(flat))
            if to - at < window and at:  # seen with the shard before
                break
            index = Shard(flat[at:to], doc[at:to])
            for name in files:
                _, _, items, starts, item = phrases_of(folder, name)
                for word, phrase, length in index.hits(folder, name):
                    spans.append(merged(at + word, at + word + length))
                    of, phrase = np.unique(np.stack((doc[at + word], phrase)), axis=1)
                    m = starts[phrase + 1] - starts[phrase]
                    of, own = np.unique(np.stack((np.repeat(of, m), item[np.repeat(starts[phrase], m) + ragged(m)])), axis=1)
                    for d, x in zip(of.tolist(), items[own].tolist(), strict=True):
                        held.setdefault(d, set()).add(x)
        start, stop = merged(*(np.concatenate(x) for x in zip(*spans, strict=True))) if spans else (np.zeros(0, np.int64),) * 2
        start, stop = split(start, stop, begin[n > 0])
        of = doc[start] if len(start) else start
        own = [np.bincount(of, minlength=len(n)), start - begin[of], stop - start]
        span = pa.StructArray.from_arrays([pa.array(own[1], pa.int64()), pa.array(own[2], pa.int64())], names=["start", "length"])
        lists = pa.array([sorted(x[1:] for x in held.get(d, ()) if x[0] == "s") for d in range(len(n))], pa.list_(pa.string()))
        return [pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(own[0]))), pa.int32()), span), lists]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text", TOGETHER):
            texts = batch.column(1)
            made = [batch.column(0), *searched(texts)]
            if with_text:
                spans = made[2].to_pylist()
                made.append(pa.array([without(t, x) if t and x else t for t, x in zip(texts.to_pylist(), spans, strict=True)], pa.string()))
            yield pa.record_batch(made, names=names)

    found = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {ids}, n_words long, spans array<struct<start: long, length: long>>, items array<string>" + ", clean_text string" * with_text)
    found = written(found, "contamination")
    deleted(spark, folder)
    return found


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns from those of contamination()."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated")
    )
