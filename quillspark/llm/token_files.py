"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

A file holds documents in ascending doc_id order. Its ids are replaced by their rank by
frequency within the file (ties by id), and ranks are coded in one to four bytes, so that
the frequent ones take one. Control bytes stand apart from the data bytes, which lets
numpy decode a file by table lookups instead of a loop:

    magic "QTOK1\\n" | n_docs, n_tokens, n_ids: u64 | doc ids: i64[n_docs] | tokens per
    document: u32[n_docs] | the id of each rank: u32[n_ids] | control bytes, two bits a
    value (bytes less one), four values a byte | data bytes | crc32 of all before: u32

Files are written by Arrow's file systems under the shared folder, under a temporary name
first, so a retried task replaces its file whole.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import rows
from quillspark.llm.tokens import encoder, word_bpe
from quillspark.shared import new_path

MAGIC = b"QTOK1\n"
#: Stands for a null doc_id in a file.
NO_ID = -(1 << 63)
#: Bytes of each of a control byte's four values, and their sum.
LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], dtype=np.uint8)


def encoded(doc_ids: list[int], counts: list[int], ids: np.ndarray) -> bytes:
    """A file of these documents: ids holds all their ids one after another."""
    n = len(ids)
    seen = np.bincount(ids, minlength=1) if n else np.zeros(1, dtype=np.int64)
    known = np.flatnonzero(seen)
    known = known[np.lexsort((known, -seen[known]))]
    rank = np.zeros(len(seen), dtype=np.uint32)
    rank[known] = np.arange(len(known), dtype=np.uint32)
    ranks = rank[ids]
    width = np.ones(n, dtype=np.uint8)
    for k in (1, 2, 3):
        width += ranks >= (1 << (8 * k))
    codes = np.zeros(-(-n // 4) * 4, dtype=np.uint8)
    codes[:n] = width - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    at = np.cumsum(width, dtype=np.int64) - width
    data = np.empty(int(width.sum(dtype=np.int64)), dtype=np.uint8)
    for k in range(int(width.max(initial=0))):
        some = width > k if k else slice(None)
        data[at[some] + k] = ranks[some] >> np.uint32(8 * k) & np.uint32(255)
    body = b"".join(
        (
            MAGIC,
            struct.pack("<QQQ", len(doc_ids), n, len(known)),
            np.asarray(doc_ids, "<i8").tobytes(),
            np.asarray(counts, "<u4").tobytes(),
            known.astype("<u4").tobytes(),
            control.tobytes(),
            data.tobytes(),
        )
    )
    return body + struct.pack("<I", zlib.crc32(body))


def decoded(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc ids, tokens per document, and all ids of a file; ValueError if it is damaged."""
    if body[:6] != MAGIC or len(body) < 34 or zlib.crc32(memoryview(body)[:-4]) != struct.unpack("<I", body[-4:])[0]:
        raise ValueError("not a whole token-id file")
    docs, n, known = struct.unpack_from("<QQQ", body, 6)
    at, parts = 30, []
    for count, kind in ((docs, "<i8"), (docs, "<u4"), (known, "<u4"), (-(-n // 4), "u1")):
        parts.append(np.frombuffer(body, kind, count, at))
        at += parts[-1].nbytes
    doc_ids, counts, table, control = parts
    data = np.frombuffer(body, np.uint8, len(body) - 4 - at, at)
    width = LENGTHS[control].reshape(-1)[:n]
    first = np.cumsum(width, dtype=np.int64) - width
    ranks = data[first].astype(np.uint32)
    for k in range(1, int(width.max(initial=1))):
        some = np.flatnonzero(width > k)
        ranks[some] |= data[first[some] + k].astype(np.uint32) << np.uint32(8 * k)
    return doc_ids, counts, table[ranks] if n else np.zeros(0, np.uint32)


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def put(folder: str, name: str, body: bytes) -> None:
    """A file in a folder of any file system that Arrow knows, whole or not at all.

    A task that is tried again finds its file's name taken, where it wrote it before: some
    file systems move onto a file, others refuse, so the older one goes first.
    """
    fs, path = opened(folder)
    fs.create_dir(path, recursive=True)
    own = f"{path}/.{name}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}"
    with fs.open_output_stream(own) as out:
        out.write(body)
    if fs.get_file_info(f"{path}/{name}").type == pafs.FileType.File:
        fs.delete_file(f"{path}/{name}")
    fs.move(own, f"{path}/{name}")


def got(folder: str, name: str) -> bytes:
    """The bytes of a file that put() wrote."""
    fs, path = opened(folder)
    with fs.open_input_stream(f"{path}/{name}") as f:
        return f.read()


def write_files(
    docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 2, file_tokens: int = 8_000_000
) -> DataFrame:
    """Write documents (doc_id, text) as token-id files in doc_id order; return the manifest.

    The manifest has a row per file: file, position (of the file in the order), n_docs,
    n_tokens and start, the ids of all files before. A null or empty text is the end id
    alone; null doc_ids come first. Repeated rows are written each; rows of one doc_id lie in
    the order of their texts' hashes, then texts, so reruns agree. Very long texts are written
    whole, other columns are ignored, an empty table gives no file. A partition above
    file_tokens takes several files.
    """
    path = tokenizer or word_bpe()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path), TaskContext.get().partitionId()
        end = enc.packed([end_id])
        held: list[tuple[int, bytes]] = []
        size, segment = 0, 0

        def file() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(b for _, b in held), enc.dtype)
            counts = [len(b) // enc.dtype.itemsize for _, b in held]
            name = f"tokens-{part:06d}-{segment:05d}.qtok"
            put(folder, name, encoded([NO_ID if d is None else d for d, _ in held], counts, ids))
            return pa.record_batch([[name], [part], [segment], [len(held)], [len(ids)]], names=["file", "part", "segment", "n_docs", "n_tokens"])

        for ids, texts in rows(batches, "doc_id", "text"):
            for d, text in zip(ids, texts, strict=True):
                own = enc.encode(text) + end
                held.append((d, own))
                size += len(own) // enc.dtype.itemsize
                if size >= file_tokens:
                    yield file()
                    held, size, segment = [], 0, segment + 1
        if held:
            yield file()

    made = (
        docs.select("doc_id", "text", F.xxhash64("text").alias("_hash"))
        .repartitionByRange("doc_id", "_hash")  # rows of one id may be many
        .sortWithinPartitions("doc_id", "_hash", "text")
        .select("doc_id", "text")
        .mapInArrow(run, "file string, part long, segment long, n_docs long, n_tokens long")
    )
    spark, at = docs.sparkSession, new_path(docs.sparkSession, "manifest")
    made.write.parquet(at)
    order = Window.orderBy("part", "segment")  # a row per file
    before = F.coalesce(F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return spark.read.schema(made.schema).parquet(at).select(
        "file", F.row_number().over(order).cast("long").alias("position"), "n_docs", "n_tokens", before.cast("long").alias("start")
    )


def read_files(spark: SparkSession, folder: str, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents of the files that a manifest names: doc_id, start, n_tokens, ids_crc32, and with_ids their ids (u32)."""
    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files, starts in rows(batches, "file", "start", step=1):
            doc_ids, counts, ids = decoded(got(folder, files[0]))
            stops = np.cumsum(counts, dtype=np.int64)
            first, raw = stops - counts, ids.astype("<u4")
            parts = [raw[a:b].tobytes() for a, b in zip(first, stops, strict=True)]
            arrays = [doc_ids, first + starts[0], counts.astype(np.int64), [zlib.crc32(x) for x in parts]]
            names = ["doc_id", "start", "n_tokens", "ids_crc32"]
            none = [doc_ids == NO_ID, None, None, None]
            yield pa.record_batch(
                [pa.array(np.asarray(x, np.int64), pa.int64(), mask=m) for x, m in zip(arrays, none, strict=True)] + [pa.array(parts, pa.binary())] * with_ids, names=names + ["ids"] * with_ids
            )

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("file", "start").repartition(parts, "file").mapInArrow(run, ddl)
