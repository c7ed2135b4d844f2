"""Periodic runs of words, by the divide and conquer of Main and Lorentz (1984).

Words are interned as numbers, and texts stand one after another with a number of its own
between each two, so that no run leaves its text. A stretch of 2^k words is cut in the
middle: a run that crosses the middle and lies in the stretch holds half of its words at
least on one side, so its period p shows there as a common extension of the middle and the
place p words further. Z-functions of both halves, forwards and backwards, give these
extensions for all p at once. A repetition that goes on beyond its stretch crosses the
middle of a larger one and is left to that. Repetitions with the same ends are one run; its
period is the smallest.

Most middles have no repetition. Before the Z-functions run, hashes of 1 to 8 words
at the middle are compared with those at each distance p, for all stretches of a size in a
few numpy operations; only stretches where one agrees go on. Equal words have equal hashes,
so nothing is lost, and the work stays n log n for any text, such as one word repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import WORD, numbers, portions, ragged, word_lists

#: Bytes of texts that are searched together, unless one text has more.
TOGETHER = 2_000_000
#: Lengths of the hashed word sequences, each the sum of two before it.
GRAMS = (1, 2, 3, 4, 6, 8)
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def z_function(x: list) -> list[int]:
    """Length of the longest common prefix of x and each of its suffixes; 0 for x itself."""
    n, left, right = len(x), 0, 0
    out = [0] * n
    for i in range(1, n):
        k = 0
        if i < right:
            k = out[i - left]
            if k < right - i:
                out[i] = k
                continue
            k = right - i
        while i + k < n and x[k] == x[i + k]:
            k += 1
        if k:
            out[i] = k
            left, right = i, i + k
    return out


def crossing(x: list[int], middle: int, least: int, times: int) -> np.ndarray:
    """Rows (start, stop, period) of the repetitions in x that a middle cuts, of each period and as long as x lets them be."""
    most = len(x) // times
    after, before = x[middle:], x[:middle][::-1]
    found = []
    p = np.arange(1, min(most, len(after) - 1) + 1)
    if len(p):
        ahead = np.array(z_function(after), np.int64)[p]
        behind = np.array(z_function([*before, None, *x[: middle + len(p)][::-1]]), np.int64)[len(before) + 1 + len(p) - p]
        found.append((middle - behind, middle + p + ahead, p))
    p = np.arange(1, min(most, len(before) - 1) + 1)
    if len(p):
        behind = np.array(z_function(before), np.int64)[p]
        ahead = np.array(z_function([*after, None, *x[middle - len(p) :]]), np.int64)[len(after) + 1 + len(p) - p]
        found.append((middle - p - behind, middle + ahead, p))
    found = [np.stack((start, stop, p), 1)[some] for start, stop, p in found if (some := stop - start >= np.maximum(least, times * p)).any()]
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def grams(x: np.ndarray) -> dict[int, np.ndarray]:
    """64-bit hashes of the sequences of each length in GRAMS that start at each place (past the end: of what is there)."""
    out = {1: (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)}
    for k in GRAMS[1:]:
        first = max(j for j in out if k - j in out)
        now, later = out[first], np.zeros(len(x), np.uint64)
        later[:-first] = out[k - first][first:]
        out[k] = (now ^ (now >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + later
    return out


def stretches(x: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int, times: int) -> Iterator[np.ndarray]:
    """(low, middle, high) of the stretches of each size in which a repetition may cross the middle; texts are x[begin:end]."""
    hashes, size = grams(x), 2
    half = lambda q: -(-max(least, times * q) // 2)  # noqa: E731  words of a run on one side of the middle, at least
    need = {k: next(q for q in range(1, 64) if max(1, half(q) - q) >= k) for k in GRAMS}  # from this period on, k words agree
    bands = [(k, need[k], stop) for k, stop in zip(GRAMS, [*(need[k] for k in GRAMS[1:]), len(x)], strict=True)]
    while size < 2 * len(x):
        size *= 2
        middle = np.arange(size // 2, len(x), size)
        text = np.searchsorted(begin, middle, "right") - 1
        low, high = np.maximum(middle - size // 2, begin[text]), np.minimum(middle + size // 2, end[text])
        some = (low < middle) & (middle < high) & (high - low >= least)
        low, middle, high = low[some], middle[some], high[some]
        marked = np.zeros(len(middle), bool)
        for side, sign in ((high - middle, 1), (middle - low, -1)):
            most = np.where(side >= half(1), np.minimum((high - low) // times, 2 * side // times), 0)
            for k, first, stop in bands:
                n = np.clip(np.minimum(most, stop - 1) - first + 1, 0, None)
                which = np.flatnonzero(n)
                if not len(which):
                    continue
                q, at = ragged(n[which]) + first, np.repeat(middle[which], n[which]) - (k if sign < 0 else 0)
                same = hashes[k][at] == hashes[k][at + sign * q]
                marked[np.repeat(which, n[which])[same]] = True
        if marked.any():
            yield np.stack((low, middle, high), 1)[marked]


def runs_of(x: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int, times: int) -> np.ndarray:
    """Rows (start, stop, period) of all maximal runs of the texts x[begin:end], sorted; numbers between texts must differ from all others."""
    found = [np.zeros((0, 3), np.int64)]
    for group in stretches(x, begin, end, least, times):
        for low, middle, high in group.tolist():
            own = crossing(x[low:high].tolist(), middle - low, least, times)
            if not len(own):
                continue
            own = own + np.array([low, low, 0])
            start, stop, period = own.T
            more = (start == low) & (x[low - 1] == x[low - 1 + period]) if low else np.zeros(len(own), bool)
            if high < len(x):
                more |= (stop == high) & (x[high] == x[high - period])
            found.append(own[~more])
    out = np.concatenate(found)
    out = out[np.lexsort((out[:, 2], out[:, 1], out[:, 0]))]
    first = np.ones(len(out), bool)
    first[1:] = (out[1:, :2] != out[:-1, :2]).any(1)
    out = out[first]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def dropped(n: int, own: np.ndarray) -> np.ndarray:
    """Which of n words stand in a run (start, stop, period) after its first period."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, own[:, 0] + own[:, 2], 1)
    np.add.at(step, own[:, 1], -1)
    return np.cumsum(step[:-1]) > 0


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """The periodic runs of the words `[^\\x20\\x09-\\x0D]+` of each whole text of docs (doc_id, text).

    A run is a stretch of neighbouring words with smallest period q (words q apart are the
    same), of `least` words and `times` periods at least (times: 3 or more), which neither
    neighbour continues. Returns a row per document: doc_id, n_words, runs (array of start,
    length, period, by start, then period) and collapsed, the words that no run holds after
    its first period, joined by one space. One pass, no shuffle; a task holds some 2 MB
    of texts at a time, or one text. Null and empty texts, and those without a word, have no
    run and an empty collapsed text; null and repeated doc_ids are documents each; other
    columns are ignored; an empty table gives no row.
    """
    if times < 3:
        raise ValueError("runs of fewer than three periods are not searched")
    ids = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text", TOGETHER):
            flat, n = word_lists(batch.column(1))
            own, known = numbers(flat)
            begin = np.cumsum(n + 1) - (n + 1)
            text = np.repeat(np.arange(len(n)), n)
            x = np.empty(len(own) + len(n), np.int64)
            x[np.arange(len(own)) + text] = own
            x[begin + n] = len(known) + np.arange(len(n))
            found = runs_of(x, begin, begin + n, least, times)
            of = np.searchsorted(begin, found[:, 0], "right") - 1
            kept = ~dropped(len(x), found)
            kept[begin + n] = False
            left = np.diff(np.append(np.cumsum(kept) - kept, int(kept.sum()))[np.append(begin, len(x))])
            words = flat.filter(pa.array(kept[np.arange(len(own)) + text]))
            start = found[:, 0] - begin[of]
            runs = pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in (start, found[:, 1] - found[:, 0], found[:, 2])], fields=list(RUN))
            yield pa.record_batch(
                [batch.column(0), pa.array(n, pa.int64()), listed(runs, np.bincount(of, minlength=len(n))), pc.binary_join(listed(words, left), " ")], names=["doc_id", "n_words", "runs", "collapsed"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {ids}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def listed(values: pa.Array, n: np.ndarray) -> pa.ListArray:
    """Lists of n values each."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), values)


def best(runs: Column) -> Column:
    """The run of the greatest exact length / period; of equal ones the first of the array. Null without runs."""

    def better(a: Column, b: Column) -> Column:
        return F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)

    return F.aggregate(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)


def planted(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with the contract's repeats: where crc32(doc_id) % 10 = 0, words from a on repeat those of a period p."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size("_w")
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    chosen = docs.select("doc_id", "text", (h % 10 == 0).alias("_some"))
    words = F.when(F.col("_some"), F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))).alias("_w")
    made = chosen.select("doc_id", "text", words).withColumns({"_a": F.when(F.size("_w") > 0, a), "_p": F.when(F.size("_w") > 0, p)})
    repeated = F.transform("_w", lambda w, i: F.when(i < F.col("_a"), w).otherwise(F.get("_w", F.col("_a") + (i - F.col("_a")) % F.col("_p"))))
    return made.select("doc_id", F.when(F.col("_a").isNotNull(), F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns from those of periodic_runs()."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    top = found.withColumn("_best", best(F.col("runs")))
    return top.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "_best.start",
        "_best.length",
        "_best.period",
        F.floor(1000 * F.col("_best.length") / F.col("_best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
