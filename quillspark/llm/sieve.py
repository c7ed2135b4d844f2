"""Rows of a wide table by their keys, without dealing out the others.

Bits of a bounded map tell which keys may be among those asked for. Every task gets the map;
only the rows that it lets through meet the keys themselves. With more keys the map lets
more through, up to all, which costs a plain join; no result depends on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a map, in rows of ROW bits (which is Spark's own length of a bitmap): 4 MB at most.
BITS, ROW = 1 << 25, 1 << 15


def _place(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BITS))


def marked(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """df with _may: false where its key is surely not one of those of ids, a table with a column of the same name."""
    places = ids.select(_place(key).alias("_place")).select(F.floor(F.col("_place") / ROW).alias("_row"), (F.col("_place") % ROW).alias("_bit"))
    bits = places.repartition("_row").groupBy("_row").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    bit = (_place(key) % ROW).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = df.withColumn("_row", F.floor(_place(key) / ROW)).join(F.broadcast(bits), "_row", "left")
    return met.select(*df.columns, F.coalesce(F.getbit(byte, bit % 8) == 1, F.lit(False)).alias("_may"))


def maybe(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of df whose key is one of those of ids, and few others."""
    return marked(df, key, ids).where("_may").drop("_may")


def without(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of df whose key is none of those of ids."""
    told = marked(df, key, ids)
    unsure = told.where("_may").drop("_may").join(ids.select(key), key, "left_anti")
    return told.where("not _may").drop("_may").union(unsure.select(*df.columns))
