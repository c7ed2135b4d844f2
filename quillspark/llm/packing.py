"""Packing documents into windows by non-negative least squares over a length histogram.

A document's ids (and an end id) are cut into whole windows and a remainder. Remainders
are binned by length, rounded up. All combinations of at most three bins that fill a
window exactly are enumerated, their repeat counts solved by non-negative least squares
against the histogram and rounded, and the remainders that are left are packed greedily:
longest first, each window filled to the brim by cutting the document that crosses its
end. Every block of a partition is packed by its own histogram, in one pass without a
shuffle; what a block's greedy part leaves of a window goes on to the next block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quillspark.llm.common import gathered, rows
from quillspark.llm.tokens import CACHED, encoder, word_bpe

SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    + [("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)


@lru_cache(maxsize=4)
def combinations(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """All multisets of one to three bins (1..bins) that add up to bins, and their count matrix (bins x sets)."""
    sets = [(bins, 0, 0)] + [(a, bins - a, 0) for a in range(bins - 1, (bins - 1) // 2, -1)]
    sets += [(a, b, bins - a - b) for a in range(1, bins) for b in range(1, a + 1) if 1 <= bins - a - b <= b]
    table = np.array(sets, dtype=np.int64)
    counts = np.zeros((bins + 1, len(table)))
    for k in range(3):
        np.add.at(counts, (table[:, k], np.arange(len(table))), 1)
    return table, counts[1:]


@lru_cache(maxsize=4)
def gram(bins: int) -> np.ndarray:
    a = combinations(bins)[1]
    return a.T @ a


def nnls(ata: np.ndarray, atb: np.ndarray, most: int = 1000) -> np.ndarray:
    """min ||Ax - b|| for x >= 0 by active sets, from A'A and A'b (Lawson and Hanson 1974; Bro and de Jong 1997)."""
    n = len(atb)
    x, free = np.zeros(n), np.zeros(n, dtype=bool)
    slope, least = atb.copy(), 1e-9 * max(1.0, np.abs(atb).max(initial=0))
    for _ in range(most):
        slope[free] = -np.inf
        k = int(slope.argmax())
        if slope[k] <= least:
            break
        free[k] = True
        while True:
            at = np.flatnonzero(free)
            own = ata[np.ix_(at, at)]
            s = np.linalg.solve(own + 1e-9 * np.eye(len(at)), atb[at])
            if s.min() > 0:
                break
            below = s <= 0
            step = (x[at][below] / (x[at][below] - s[below])).min()
            x[at] += step * (s - x[at])
            gone = at[x[at] <= 1e-12]
            if not len(gone):
                gone = at[below][:1]
            x[gone], free[gone] = 0, False
            if not free.any():
                s, at = np.zeros(0), np.zeros(0, dtype=int)
                break
        x[:] = 0
        x[at] = s
        slope = atb - ata[:, at] @ s
    return x


def repeats(histogram: np.ndarray) -> np.ndarray:
    """Whole repeat counts of each combination that use no bin more often than the histogram has it."""
    table, counts = combinations(len(histogram))
    x = np.floor(nnls(gram(len(histogram)), counts.T @ histogram) + 0.5).astype(np.int64)
    over = counts @ x - histogram
    for k in np.argsort(-x, kind="stable"):
        if not x[k] or not (over > 0).any():
            break
        used = counts[:, k] > 0
        cut = min(x[k], int(np.ceil((over[used] / counts[used, k]).max())))
        if cut > 0:
            x[k] -= cut
            over -= counts[:, k] * cut
    return x


class Packer:
    """Packs the blocks of one partition. Ids are packed little-endian integers of a dtype."""

    def __init__(self, window: int, width: int, dtype: np.dtype, base: int, names: list[str]):
        if window % width:
            raise ValueError("the window is no multiple of the bin width")
        self.window, self.width, self.dtype, self.next, self.names = window, width, dtype, base, names
        self.tail: list[tuple] = []  # pieces (doc_id, ids, start, length, all) in the open window
        self.open = 0

    def block(self, docs: list[tuple[int, bytes]]) -> dict[str, list]:
        window, docs = self.window, [(d, np.frombuffer(b, self.dtype)) for d, b in docs]
        out: dict[str, list] = {n: [] for n in self.names}
        lengths = np.array([len(a) for _, a in docs], dtype=np.int64)
        for d, a in docs:
            for k in range(len(a) // window):
                self.put(out, (d, a, k * window, window, len(a)), self.next, 0)
                self.next += 1
        rest = lengths % window
        bins = window // self.width
        order = np.flatnonzero(rest)
        order = order[np.argsort(rest[order], kind="stable")]
        of = -(-rest[order] // self.width)
        histogram = np.bincount(of, minlength=bins + 1)[1:]
        first = np.concatenate(([0, 0], np.cumsum(histogram)))  # of each bin in order
        x, table = repeats(histogram.astype(float)), combinations(bins)[0]
        used = np.zeros(bins + 1, dtype=np.int64)
        for k in np.flatnonzero(x):
            n, members = int(x[k]), []
            for b in table[k]:
                if b:
                    members.append(order[first[b] + used[b] : first[b] + used[b] + n])
                    used[b] += n
            for i in range(n):
                at = 0
                for m in members:
                    d, a = docs[m[i]]
                    self.put(out, (d, a, len(a) - int(rest[m[i]]), int(rest[m[i]]), len(a)), self.next, at)
                    at += int(rest[m[i]])
                self.next += 1
        left = np.concatenate([order[first[b] + used[b] : first[b + 1]] for b in range(1, bins + 1)])
        for i in left[::-1]:
            d, a = docs[i]
            start = len(a) - int(rest[i])
            while start < len(a):
                n = min(len(a) - start, window - self.open)
                self.tail.append((d, a, start, n, len(a)))
                self.open, start = self.open + n, start + n
                if self.open == window:
                    self.shut(out)
        return out

    def shut(self, out: dict[str, list]) -> None:
        at = 0
        for piece in self.tail:
            self.put(out, piece, self.next, at)
            at += piece[3]
        self.next, self.tail, self.open = self.next + 1, [], 0

    def end(self) -> dict[str, list]:
        """The last open window, cut into sequences whose lengths are powers of two: none of them needs padding."""
        out: dict[str, list] = {n: [] for n in self.names}
        rest, self.tail, total = self.tail, [], self.open
        while total:
            room = 1 << (total.bit_length() - 1)
            total -= room
            while room:
                d, a, start, n, whole = rest.pop(0)
                k = min(n, room)
                self.tail.append((d, a, start, k, whole))
                room -= k
                if k < n:
                    rest.insert(0, (d, a, start + k, n - k, whole))
            self.shut(out)
        return out

    def put(self, out: dict[str, list], piece: tuple, sequence: int, offset: int) -> None:
        d, a, start, n, whole = piece
        ids = a[start : start + n].astype("<u4").tobytes()
        for name, v in zip(self.names, (d, start, n, zlib.crc32(ids), whole, sequence, offset, ids), strict=False):
            out[name].append(v)


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    window: int = 2048,
    width: int = 16,
    end_id: int = 1,
    block_tokens: int = 6_000_000,
    with_ids: bool = False,
    cached: int = CACHED,
) -> DataFrame:
    """Pieces of all documents (doc_id, text) with their place in a packed sequence.

    A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and
    with_ids the ids as little-endian 32-bit integers. A null or empty text is the end id
    alone. Repeated rows are documents of their own. Other columns are ignored; an empty
    table gives no piece. sequence_id holds the partition in its upper bits. A worker keeps
    the ids of `cached` words, which only trades memory for time.
    """
    path = tokenizer or word_bpe()
    schema = SCHEMA.append(pa.field("ids", pa.binary())) if with_ids else SCHEMA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, cached)
        end = enc.packed([end_id])
        packer = Packer(window, width, enc.dtype, TaskContext.get().partitionId() << 36, schema.names)
        block, size = [], 0
        for ids, texts in rows(batches, "doc_id", "text"):
            for d, text in zip(ids, texts, strict=True):
                own = enc.encode(text) + end
                block.append((d, own))
                size += len(own) // enc.dtype.itemsize
                if size >= block_tokens:
                    yield gathered(packer.block(block), schema)
                    block, size = [], 0
        if block:
            yield gathered(packer.block(block), schema)
        yield gathered(packer.end(), schema)

    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return docs.select("doc_id", "text").mapInArrow(run, ddl + (", ids binary" if with_ids else ""))
