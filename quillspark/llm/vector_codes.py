"""Product codes of vectors: codebooks by Lloyd's rounds with heaps of slacks.

Vectors are integers, cut into equal parts; each part position has its own codebook. After
a first full assignment, a part keeps its slack, the distance of the second nearest entry
less that of its own. An entry that moves by d can bring both bounds nearer by no more than
d and the largest move of another entry, so the sum of those moves over the rounds, an
entry's drift, tells which parts may have another nearest entry: those whose slack, keyed by
the drift at the time it was measured, is at most the drift now. Each entry has a heap by
that key in each block of vectors (Hamerly and Drake 2015); only what stands below the drift
is popped, measured exactly against all entries and pushed again. The others keep their
entry, so rounds give what full rounds give, to the last tie.

Blocks of vectors are files in the shared folder; the heaps of a round are a table of a row
per block, written anew each round. Rounds send back only the sums of parts that moved, added
up by entry and component.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.token_files import got, put
from quillspark.shared import deleted, dropped, new_path, written

BLOCK = 16_384
#: Keys are differences of roots: room for their rounding.
ROOM = 1e-5
STATE = "file string, entries binary, sizes binary, keys binary, members binary, moved array<struct<position: int, entry: int, sums: array<long>>>, popped long"


def squares(parts: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of parts (rows) to entries (columns)."""
    largest = max(int(np.abs(parts).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.float64 if 4 * parts.shape[1] * largest**2 < 1 << 53 else np.int64  # sums of whole numbers are exact in either
    a, b = parts.astype(kind), book.astype(kind)
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)


def nearest(parts: np.ndarray, book: np.ndarray, step: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part (ties: the lowest) and its slack: the distance of the next one less its own."""
    entry, slack = np.zeros(len(parts), np.int64), np.full(len(parts), np.inf)
    for at in range(0, len(parts), step):
        d = squares(parts[at : at + step], book)
        own = d.argmin(1)
        entry[at : at + step] = own
        if len(book) > 1:
            first = d[np.arange(len(d)), own]
            d[np.arange(len(d)), own] = np.iinfo(np.int64).max
            slack[at : at + step] = np.sqrt(d.min(1)) - np.sqrt(first)
    return entry, slack


class Heaps:
    """The parts of one position in a block: their entries, and for each entry a heap of (key, part)."""

    def __init__(self, entry: np.ndarray, sizes: np.ndarray, keys: np.ndarray, members: np.ndarray):
        self.entry, self.own = entry, {}
        self.bounds, self.keys, self.members = np.concatenate(([0], np.cumsum(sizes))), keys, members

    @classmethod
    def made(cls, entry: np.ndarray, keys: np.ndarray, entries: int) -> Heaps:
        order = np.lexsort((keys, entry))  # sorted, so a heap
        return cls(entry, np.bincount(entry, minlength=entries), keys[order], order)

    def heap(self, a: int) -> list[tuple[float, int]]:
        if a not in self.own:
            at = slice(self.bounds[a], self.bounds[a + 1])
            self.own[a] = list(zip(self.keys[at].tolist(), self.members[at].tolist(), strict=True))
        return self.own[a]

    def popped(self, drift: np.ndarray) -> list[int]:
        """Take off the parts whose key the drift of their entry has reached."""
        tops = np.where(self.bounds[1:] > self.bounds[:-1], np.append(self.keys, np.inf)[self.bounds[:-1]], np.inf)
        out = []
        for a in np.flatnonzero(tops <= drift + ROOM).tolist():
            heap, bound = self.heap(a), drift[a] + ROOM
            while heap and heap[0][0] <= bound:
                out.append(heapq.heappop(heap)[1])
        return out

    def push(self, part: int, entry: int, key: float) -> None:
        self.entry[part] = entry
        heapq.heappush(self.heap(entry), (key, part))

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.diff(self.bounds)
        keys, members = [], []
        for a in range(len(sizes)):
            if a in self.own:
                sizes[a] = len(self.own[a])
                keys.append(np.array([k for k, _ in self.own[a]], np.float64))
                members.append(np.array([m for _, m in self.own[a]], np.int64))
            else:
                at = slice(self.bounds[a], self.bounds[a + 1])
                keys.append(self.keys[at])
                members.append(self.members[at])
        return self.entry.astype(np.int32), sizes.astype(np.int32), np.concatenate(keys), np.concatenate(members).astype(np.int32)


def moved(position: int, parts: np.ndarray, before: np.ndarray | None, after: np.ndarray, entries: int) -> list[dict]:
    """Count and sums by component, as changes, of each entry that these parts leave or reach."""
    sums = np.zeros((entries, parts.shape[1] + 1), np.int64)
    rows = np.concatenate((np.ones((len(parts), 1), np.int64), parts), 1)
    some = slice(None) if before is None else np.flatnonzero(before != after)
    np.add.at(sums, after[some], rows[some])
    if before is not None:
        np.subtract.at(sums, before[some], rows[some])
    return [{"position": position, "entry": a, "sums": sums[a].tolist()} for a in np.flatnonzero(sums.any(1)).tolist()]


def packed(arrays: list[np.ndarray]) -> bytes:
    return b"".join(a.tobytes() for a in arrays)


def ipc(batch: pa.RecordBatch) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema) as stream:
        stream.write_batch(batch)
    return out.getvalue()


def of_ipc(body: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(body).read_next_batch()


def parts_of(folder: str, file: str, position: int, width: int) -> np.ndarray:
    return np.frombuffer(got(folder, f"{file}.{position}"), np.int32).astype(np.int64).reshape(-1, width)


def whole(vectors: DataFrame, scale: int, positions: int) -> tuple[DataFrame, int]:
    """vec_id, label and the integer components of the rows that are kept, and a part's width.

    Components are cut off where the squared distances of such vectors could leave 64 bits.
    """
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where(F.col("embedding").isNotNull() & fine).select("vec_id", "label", "embedding")
    width = -(-(kept.agg(F.max(F.size("embedding"))).first()[0] or 0) // positions)
    most = min(isqrt((1 << 60) // max(1, width * positions)), (1 << 31) - 1)
    ints = F.transform("embedding", lambda x: F.greatest(F.lit(-most), F.least(F.lit(most), F.floor(x.cast("double") * scale))).cast("int"))
    return kept.select("vec_id", "label", ints.alias("_v")), width


def coded(
    vectors: DataFrame, entries: int = 256, positions: int = 4, rounds: int = 4, scale: int = 1024, block: int = BLOCK
) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of vectors (vec_id, embedding, label), and the codebooks of each part position.

    Rows whose vector is null or holds a null or non-finite component are dropped; a
    component x becomes floor(scale * x), within the bounds of whole(). Vectors are cut into
    `positions` equal parts; shorter vectors, and lengths that do not divide, are filled with
    zeros at the end. Codebooks start as the parts of the `entries` (at most 256) least
    vec_ids, nulls last, ties by the vectors; with fewer rows there are fewer entries. Each
    round assigns all parts and moves entries to their parts' mean, rounded down; unused
    entries stay. Then parts are assigned again. The table has a row per kept row: vec_id,
    label, code (two hexadecimal digits a part) and error (squared distances, added up).
    Repeated ids are vectors each; an empty table gives no row and empty codebooks. Other
    columns are ignored.

    The driver holds the codebooks: `entries` vectors. Lost tasks write their files and rows again.
    """
    spark = vectors.sparkSession
    kept, width = whole(vectors, scale, positions)
    folder, full = new_path(spark, "vector-blocks"), width * positions
    id_type, label_type = (vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label"))

    def padded(lists: pa.ListArray) -> np.ndarray:
        n, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
        out = np.zeros((len(n), full), np.int32)
        at = np.repeat(np.arange(len(n)), n)
        out[at, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
        return out

    first = [tuple(r["_v"]) + (0,) * (full - len(r["_v"])) for r in kept.orderBy(F.asc_nulls_last("vec_id"), "_v").select("_v").limit(entries).collect()]
    books = list(np.array(first, np.int64).reshape(len(first), positions, width).transpose(1, 0, 2))
    if not first:
        return kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), books

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held, size, made = [], 0, 0

        def state() -> pa.RecordBatch:
            file = f"block-{part:06d}-{made:06d}"
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            put(folder, f"{file}.rows", ipc(rows.select(["vec_id", "label"])))
            v = padded(rows.column(2))
            heaps, sums = [], []
            for k, book in enumerate(books):
                own = np.ascontiguousarray(v[:, k * width : (k + 1) * width])
                put(folder, f"{file}.{k}", own.tobytes())
                entry, slack = nearest(own.astype(np.int64), book)
                heaps.append(Heaps.made(entry, slack, len(book)))
                sums += moved(k, own.astype(np.int64), None, entry, len(book))
            return row(file, heaps, sums, len(v) * positions)

        for batch in batches:
            for at in range(0, batch.num_rows, block):
                some = batch.slice(at, block)
                if held and size + some.num_rows > block:
                    yield state()
                    held, size, made = [], 0, made + 1
                held.append(some)
                size += some.num_rows
        if held:
            yield state()

    def row(file: str, heaps: list[Heaps], sums: list[dict], n: int) -> pa.RecordBatch:
        kind = pa.list_(pa.struct([("position", pa.int32()), ("entry", pa.int32()), ("sums", pa.list_(pa.int64()))]))
        binary = [pa.array([packed(x)], pa.binary()) for x in zip(*(h.arrays() for h in heaps), strict=True)]
        return pa.record_batch([pa.array([file]), *binary, pa.array([sums], kind), pa.array([n], pa.int64())], names=["file", "entries", "sizes", "keys", "members", "moved", "popped"])

    def read(batch: pa.RecordBatch, i: int) -> tuple[str, list[Heaps]]:
        file, *raw = (batch.column(k)[i].as_py() for k in range(5))
        arrays = [np.split(np.frombuffer(x, kind), positions) for x, kind in zip(raw, (np.int32, np.int32, np.float64, np.int32), strict=True)]
        return file, [Heaps(e.astype(np.int64), s, k, m) for e, s, k, m in zip(*arrays, strict=True)]

    def round_of(books: list[np.ndarray], drift: list[np.ndarray]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    file, heaps = read(batch, i)
                    sums, n = [], 0
                    for k, (h, book) in enumerate(zip(heaps, books, strict=True)):
                        if not (some := h.popped(drift[k])):
                            continue
                        own = parts_of(folder, file, k, width)[some]
                        before = h.entry[some]
                        entry, slack = nearest(own, book)
                        for part, a, key in zip(some, entry.tolist(), (slack + drift[k][entry]).tolist(), strict=True):
                            h.push(part, a, key)
                        sums += moved(k, own, before, entry, len(book))
                        n += len(some)
                    yield row(file, heaps, sums, n)

        return run

    state = written(kept.mapInArrow(blocks, STATE), "heaps")
    totals = [np.zeros((len(b), width + 1), np.int64) for b in books]
    drift = [np.zeros(len(b)) for b in books]
    for _ in range(rounds):
        flat = state.select(F.explode("moved").alias("m")).select("m.position", "m.entry", F.posexplode("m.sums").alias("at", "sum"))
        for r in flat.groupBy("position", "entry", "at").agg(F.sum("sum").alias("sum")).toLocalIterator():  # of the codebooks' size
            totals[r["position"]][r["entry"], r["at"]] += r["sum"]
        for k, (book, total) in enumerate(zip(books, totals, strict=True)):
            used = total[:, 0] > 0
            after = book.copy()
            after[used] = total[used, 1:] // total[used, :1]
            move = np.sqrt(((after - book) ** 2).sum(1))
            top = np.sort(move)[::-1][:2]
            others = np.where(np.arange(len(move)) == move.argmax(), top[1] if len(top) > 1 else 0.0, top[0])
            drift[k] = drift[k] + move + others
            books[k] = after
        then = written(state.mapInArrow(round_of(list(books), list(drift)), STATE), "heaps")
        dropped(state)
        state = then

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                file = batch.column(0)[i].as_py()
                entries = np.split(np.frombuffer(batch.column(1)[i].as_py(), np.int32), positions)
                own = of_ipc(got(folder, f"{file}.rows"))
                error = sum(((parts_of(folder, file, k, width) - books[k][e]) ** 2).sum(1) for k, e in enumerate(entries))
                code = np.stack(entries, 1).astype(np.uint8).tobytes().hex()
                codes = [code[at : at + 2 * positions] for at in range(0, len(code), 2 * positions)]
                yield pa.record_batch([own.column(0), own.column(1), pa.array(codes, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    out = written(state.select("file", "entries").mapInArrow(rows, f"vec_id {id_type}, label {label_type}, code string, error long"), "codes")
    dropped(state)
    deleted(spark, folder)
    return out, books


def with_label_errors(codes: DataFrame, broadcast_rows: int = 100_000) -> DataFrame:
    """codes (label, error) with label_error, the sum of error over equal labels, nulls together (null beyond 64 bits).

    Sums are partial aggregates. They are broadcast when their counted rows are few; else
    rows meet them in a join that adaptive execution splits where a label is frequent.
    """
    sums = codes.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error"))
    few = sums.limit(broadcast_rows + 1).count() <= broadcast_rows
    return codes.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")


def listing(books: list[np.ndarray]) -> str:
    """All entries' components in decimal by part, entry and place."""
    return ",".join(map(str, np.concatenate([b.reshape(-1) for b in books]).tolist())) if books else ""
