"""What several operators share: rows of Arrow batches, words, letters."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import SparkSession
from pyspark.sql import types as T

#: A word of the corpus contracts: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: A word of the classifiers: a run of letters, with the marks that follow them.
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*+")


def word_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of texts (null: none) between ASCII white space, one after another, and each text's number of them."""
    lists = pc.ascii_split_whitespace(texts.fill_null(""))
    flat, at = lists.flatten(), lists.offsets.to_numpy()
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    before = np.concatenate((np.zeros(1, np.int64), np.cumsum(real)))[at - at[0]]
    return flat.filter(pa.array(real)), np.diff(before)


def numbers(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of each word, from 0 in the order of first occurrence, and the distinct words."""
    made = words.dictionary_encode()
    return made.indices.to_numpy(zero_copy_only=False).astype(np.int64), made.dictionary


def portions(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches whose texts have some `most` bytes together, or more in one text."""
    for batch in batches:
        n = pc.binary_length(batch.column(batch.schema.get_field_index(text))).fill_null(0).to_numpy(zero_copy_only=False)
        before, at = np.cumsum(n) - n, 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(before, before[at] + most)))
            yield batch.slice(at, to - at)
            at = to


def ragged(n: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n, one after another."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def rows(batches: Iterator[pa.RecordBatch], *names: str, step: int = 512) -> Iterator[tuple[list, ...]]:
    """Columns as Python lists, some hundred rows at a time: long texts never pile up."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield tuple(part.column(part.schema.get_field_index(n)).to_pylist() for n in names)


def released() -> None:
    """Hand freed memory back to the system: a worker lives on, idle or for later stages, beside others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of few rows for jobs that run inside: long texts fill large ones on both sides of a worker's pipe."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def gathered(values: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    """One record batch from lists or lists of numpy pieces."""
    out = []
    for field in schema:
        v = values[field.name]
        if v and isinstance(v[0], np.ndarray):
            v = np.concatenate(v)
        out.append(pa.array(v, type=field.type))
    return pa.record_batch(out, schema=schema)


def with_columns(schema: T.StructType, *more: str) -> T.StructType:
    """schema and columns like "name type" after it."""
    out = T.StructType(list(schema.fields))
    for x in more:
        out = out.add(*x.split(" "))
    return out
