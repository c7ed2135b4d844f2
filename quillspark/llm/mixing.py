"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

Targets share the corpus' words among sources by weight, none above a multiple of its
source; the excess is reshared by weight (water filling, in closed form over the sources
sorted by cap per weight). The total is cut into equal blocks, which go to sources by
highest quotients v/1, v/3, v/5 ..., and from a source to its shards in the same way. A
shard is a hash bucket of a source's documents of bounded size, so a source that holds
most of the corpus is many shards. Within a shard documents lie in seeded order on a line
of blocks; whole passes over it and then the blocks from its start are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import WORD
from quillspark.shared import written

ALL = (Window.unboundedPreceding, Window.unboundedFollowing)


def apportioned(parties: DataFrame, votes: str, seats: Column, by: list[str], order: list[Column], quota: str) -> DataFrame:
    """parties with their Sainte-Lague share (quota) of the seats of their group (by).

    Every multiplier m that hands out all N seats of n parties by round(m * N * share)
    lies within 1 -+ n / 2N. So only seats between those bounds compete; their
    quotients are ranked, about four a party.
    """
    group = Window.partitionBy(*by)
    df = parties.withColumns({"_n": F.count(F.lit(1)).over(group), "_all": F.sum(votes).over(group), "_seats": seats.cast("double")})
    exact = F.when((F.col("_all") > 0) & (F.col("_seats") > 0), F.col(votes) * F.col("_seats") / F.col("_all")).otherwise(0.0)
    df = df.withColumn("_exact", exact).withColumn("_slack", F.when(F.col("_seats") > 0, F.col("_n") / (2 * F.col("_seats"))).otherwise(0.0))
    low = F.greatest(F.lit(0), F.ceil(F.col("_exact") * (1 - F.col("_slack")) - 0.5) - 1).cast("long")
    high = (F.floor(F.col("_exact") * (1 + F.col("_slack")) + 0.5) + 1).cast("long")
    df = df.withColumn("_low", low).withColumn("_left", F.col("_seats") - F.sum("_low").over(group))
    rival = F.when(F.col("_exact") > 0, F.sequence(F.col("_low") + 1, high))
    df = df.withColumn("_seat", F.explode_outer(rival)).withColumn("_quotient", F.col(votes) / (2 * F.col("_seat") - 1))
    rank = F.row_number().over(group.orderBy(F.col("_quotient").desc_nulls_last(), *order))
    df = df.withColumn("_won", (F.col("_seat").isNotNull() & (rank <= F.col("_left"))).cast("long"))
    won = df.groupBy(*parties.columns).agg((F.max("_low") + F.sum("_won")).alias(quota))
    return won


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """sizes (source, source_size) with target: shares of the whole by weight, none above most times its source.

    Sources in code-point order, null last, weigh weights[0], weights[1], ..., repeating.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())  # a row per source
    df = sizes.withColumn("_at", F.row_number().over(place))
    df = df.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("_at") - 1) % len(weights) + 1).cast("int")))
    df = df.withColumns({"_cap": (most * F.col("source_size")).cast("double"), "_total": F.sum("source_size").over(Window.partitionBy())})
    df = df.withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    below = Window.orderBy("_ratio", "_at").rowsBetween(Window.unboundedPreceding, -1)
    full, weight = F.coalesce(F.sum("_cap").over(below), F.lit(0.0)), F.coalesce(F.sum("_weight").over(below), F.lit(0))
    df = df.withColumn("_level", (F.col("_total") - full) / (F.sum("_weight").over(Window.partitionBy()) - weight))
    first = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_at", "_level"))).over(Window.partitionBy())
    target = F.coalesce(F.least(F.col("_cap"), first["_level"] * F.col("_weight")), F.lit(0.0))
    return df.select("source", "source_size", target.alias("target"), "_total")


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    most: int = 3,
    blocks: int = 1_000_000,
    shard_words: int = 2_000_000,
    seed: int = 17,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """What a mix takes of each document (doc_id, text, source): doc_id, size, source_size, target, taken, and the columns `carry`.

    size counts words (null or empty text: 0; such documents give and get nothing), taken
    the words that the mix takes, repeats counted, at most `most` times size. Blocks hold
    a blocks-th of all words, at least one word. The order within a shard is that of a
    hash of seed and doc_id, then doc_id, then size; so reruns agree, however the rows are
    partitioned. A null source is a source of its own, the last. Repeated rows count each,
    and so do rows without an id, which are dealt by their texts. Very long texts are
    counted whole. Other columns are ignored; an empty table gives no row.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit(":"), F.md5(F.coalesce("text", F.lit("")))))
    mark = F.conv(F.left(F.md5(F.concat(F.lit(f"{seed}:"), name)), F.lit(15)), 16, 10).cast("long").alias("_mark")
    sized = written(docs.select("doc_id", "source", size.alias("size"), mark, *[F.col(c).alias(f"_carry_{c}") for c in carry]), "sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    block = F.greatest(F.lit(1), F.floor(F.col("_total") / blocks)).cast("long")
    parts = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long")
    shares = apportioned(targets(sizes, weights, most).withColumn("_block", block), "target", F.round(F.col("_total") / F.col("_block")), [], [F.col("source").asc_nulls_last()], "_quota")
    shares = written(shares.withColumn("_parts", parts), "targets").withColumnRenamed("source", "_source")
    shard = F.pmod("_mark", F.col("_parts"))
    dealt = sized.join(shares, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_shard", shard)
    held = ["_source", "_shard", "_quota", "_block"]
    shards = dealt.groupBy(*held).agg(F.sum("size").alias("_words"))
    shards = apportioned(shards, "_words", F.col("_quota"), ["_source"], [F.col("_shard")], "_blocks")
    take = F.least(F.col("_blocks") * F.col("_block"), most * F.col("_words"))
    shards = shards.select(F.col("_source").alias("_of"), F.col("_shard").alias("_part"), "_words", take.alias("_take"))
    line = Window.partitionBy("_source", "_shard").orderBy("_mark", "doc_id", "size", *[f"_carry_{c}" for c in carry])
    before = F.coalesce(F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    passes = F.when(F.col("_words") > 0, F.floor(F.col("_take") / F.col("_words"))).otherwise(0)
    rest = F.col("_take") - passes * F.col("_words")
    taken = passes * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before")))
    both = dealt.join(shards, F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_shard") == F.col("_part")))
    return both.withColumn("_before", before).select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), *[F.col(f"_carry_{c}").alias(c) for c in carry])
