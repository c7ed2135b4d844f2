"""Connected components of an edge list, in rounds of alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.shared import dropped, observed


def connected(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, component) of edges (a, b): the smallest node reachable. Nodes with no edge to another are absent.

    Large-star and small-star rounds (Kiveris et al. 2014) until a round changes nothing,
    which a check sum tells that is gathered as the round is written. Edges stay distributed;
    hubs never meet in one task: minima are partial aggregates, and rows go back by joins
    that adaptive execution may split. The result is a table in the shared folder.
    """
    figures = F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64("a", "b")).alias("sum")
    start = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, told = observed(start, tag, *figures)
    while told["rows"]:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").union(down)
        then, found = observed(small.distinct(), tag, *figures)
        dropped(now)
        now, same, told = then, found == told, found
        if same:
            break
    out = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = out.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    out.written_to = now.written_to
    return out
