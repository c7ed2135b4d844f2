"""Choice of documents for an analysis: exact and near duplicates, and relevance to anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.shared import written


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(v: Column) -> Column:
    """A vector of length 1; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def exact_duplicates(docs: DataFrame, key: str = "title_key", words: str = "words", order: str = "doc_id") -> DataFrame:
    """doc_id, decision and duplicate_of: of documents with one key the one of most words, then the first, stays.

    With one kind of key the greedy rule is a least place; documents without a key all stay.
    """
    own = F.when(F.col(key) == "", F.concat(F.lit("-"), F.col(order).cast("string"))).otherwise(F.concat(F.lit("+"), F.col(key)))
    keyed = docs.withColumn("_k", own)
    best = keyed.groupBy(F.col("_k").alias("_key")).agg(F.min(F.struct(F.col(words).isNull(), -F.col(words), order)).alias("_b"))  # a title may stand in very many documents
    out = keyed.join(best, F.col("_k") == F.col("_key")).withColumn("_best", F.col(f"_b.{order}"))
    again = F.col("_best") != F.col(order)
    return out.select(order, F.when(again, "duplicate").otherwise("include").alias("decision"), F.when(again, F.col("_best")).alias("duplicate_of"))


def title_pairs(titles: DataFrame, least: float = 0.85) -> DataFrame:
    """Pairs of distinct normalised titles of a token Jaccard similarity of `least` or more: a, b, jaccard.

    Titles meet on their rarest tokens alone: pairs of that similarity share one of the
    first n - ceil(least * n) + 1 tokens in an order by rising frequency.
    """
    own = written(titles.select("title").where("title <> ''").distinct().withColumn("_i", F.monotonically_increasing_id()), "titles")  # ids stay
    tokens = F.array_distinct(F.split("title", " "))
    flat = own.select("_i", F.size(tokens).alias("_n"), F.explode(tokens).alias("token"))
    seen = flat.groupBy("token").agg(F.count(F.lit(1)).alias("_df"))
    ranked = flat.join(seen, "token").withColumn("_r", F.row_number().over(Window.partitionBy("_i").orderBy("_df", "token")))
    entry = ranked.where(F.col("_r") <= F.col("_n") - F.ceil(F.col("_n") * least - 1e-9) + 1).select("token", "_i", "_n")
    x, y = entry.alias("x"), entry.alias("y")
    sizes = (F.col("x._n") >= least * F.col("y._n") - 1e-9) & (F.col("y._n") >= least * F.col("x._n") - 1e-9)
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x._i") < F.col("y._i")) & sizes)
    met = met.select(F.col("x._i").alias("_x"), F.col("y._i").alias("_y")).distinct()
    met = met.join(own.toDF("_s", "_x"), "_x").join(own.toDF("_t", "_y"), "_y")
    likeness = text.jaccard(F.array_distinct(F.split("_s", " ")), F.array_distinct(F.split("_t", " ")))
    pairs = met.select(F.least("_s", "_t").alias("a"), F.greatest("_s", "_t").alias("b"), likeness.alias("jaccard"))
    return pairs.where(F.col("jaccard") >= least)


def near_duplicates(docs: DataFrame, pairs: DataFrame, least: float = 0.97) -> DataFrame:
    """Pairs of documents (doc_id, title, vector) whose titles pair or are equal and whose vectors' cosine is `least`."""
    d = docs.select("doc_id", "title", unit(F.col("vector")).alias("_v"))
    same = d.select("title").distinct().select(F.col("title").alias("a"), F.col("title").alias("b"), F.lit(1.0).alias("jaccard")).where("a <> ''")
    x, y = d.alias("x"), d.alias("y")
    found = pairs.unionByName(same).join(x, F.col("a") == F.col("x.title")).join(y, F.col("b") == F.col("y.title"))
    found = found.where((F.col("a") != F.col("b")) | (F.col("x.doc_id") < F.col("y.doc_id")))
    cos = dot(F.col("x._v"), F.col("y._v"))
    low, high = F.least("x.doc_id", "y.doc_id"), F.greatest("x.doc_id", "y.doc_id")
    return found.select(low.alias("first_id"), high.alias("second_id"), "jaccard", cos.alias("cosine")).where(F.col("cosine") >= least)


def greedy_duplicates(pairs: DataFrame) -> DataFrame:
    """The pairs (earlier, later) whose earlier side is kept and whose later side is not, by a walk in rank order.

    An item goes if a kept earlier one pairs with it; one that went removes nothing. In
    rounds: items that no open pair has as its later side are kept, their partners go.
    """
    pairs = written(pairs, "pairs")
    rest, gone = pairs.select("earlier", "later"), None
    while rest.limit(1).count():
        kept = rest.select("earlier").join(rest.select(F.col("later").alias("earlier")), "earlier", "left_anti").distinct()
        now = written(rest.join(kept, "earlier", "left_semi").select("later").distinct(), "gone")
        gone = now if gone is None else gone.union(now)
        rest = written(rest.join(now, "later", "left_anti").join(now.withColumnRenamed("later", "earlier"), "earlier", "left_anti"), "rest")
    if gone is None:
        return pairs
    return pairs.join(gone, "later", "left_semi").join(gone.withColumnRenamed("later", "earlier"), "earlier", "left_anti")


def resolved(docs: DataFrame) -> DataFrame:
    """Decision of each document (doc_id, title, words, vector), duplicate_of, and the likeness to it of near duplicates.

    Exact duplicates go first; of the others, by most words and then doc_id, each one is
    compared with kept ones only and goes to the first that matches.
    """
    exact = written(exact_duplicates(docs.select("doc_id", "title", "words"), "title"), "exact")
    own = docs.join(exact.where("decision = 'include'").select("doc_id"), "doc_id", "left_semi")
    words = own.select("doc_id", "words")
    found = near_duplicates(own, title_pairs(own))
    found = found.join(words.toDF("first_id", "_n"), "first_id").join(words.toDF("second_id", "_m"), "second_id")
    ahead = F.col("_n") >= F.col("_m")  # first_id is the smaller one
    found = found.select(F.when(ahead, F.col("first_id")).otherwise(F.col("second_id")).alias("earlier"), F.when(ahead, F.col("second_id")).otherwise(F.col("first_id")).alias("later"), F.greatest("_n", "_m").alias("_words"), "jaccard", "cosine")
    owner = F.min(F.struct(-F.col("_words"), "earlier", "jaccard", "cosine")).alias("_o")
    near = greedy_duplicates(found).groupBy(F.col("later").alias("doc_id")).agg(owner)
    out = exact.join(near, "doc_id", "left")
    return out.select(
        "doc_id",
        F.when(F.col("_o").isNotNull(), "duplicate").otherwise(F.col("decision")).alias("decision"),
        F.coalesce("_o.earlier", "duplicate_of").alias("duplicate_of"),
        F.col("_o.jaccard").alias("jaccard"),
        F.col("_o.cosine").alias("cosine"),
    )


def relevance(vectors: DataFrame, anchors: DataFrame, summary: int = 0, best: int = 3) -> DataFrame:
    """Score of each vector (id, vector): 0.6 of its likeness to the summary anchor, 0.4 of the mean of its best query anchors.

    anchors: anchor (from 0), vector; a reader's profile has a few dozen at most, so they
    travel as one array.
    """
    packed = anchors.agg(F.array_sort(F.collect_list(F.struct("anchor", unit(F.col("vector")).alias("v")))).alias("_a"))
    own = vectors.select("id", unit(F.col("vector")).alias("_v")).crossJoin(F.broadcast(packed))  # one row
    said = F.filter("_a", lambda a: a["anchor"] == summary)
    others = F.transform(F.filter("_a", lambda a: a["anchor"] != summary), lambda a: dot(a["v"], F.col("_v")))
    top = F.slice(F.sort_array(others, asc=False), 1, best)
    mean = F.aggregate(top, F.lit(0.0), lambda s, v: s + v) / F.size(top)
    score = 0.6 * dot(F.element_at(said, 1)["v"], F.col("_v")) + 0.4 * mean
    return own.select("id", score.alias("relevance_score"))


def relevance_decisions(scores: DataFrame, cap: float = 0.22, share: float = 0.10, least: int = 8) -> DataFrame:
    """decision of each score: below the lower of `cap` and the `share` quantile is low, in pools of `least` or more."""
    cut = scores.agg(F.percentile("relevance_score", F.lit(share)).alias("_q"), F.count(F.lit(1)).alias("_n"))
    cutoff = F.when(F.col("_n") >= least, F.least(F.lit(cap), F.col("_q")))
    out = scores.crossJoin(F.broadcast(cut)).withColumn("cutoff", cutoff)  # one row
    return out.select("id", "relevance_score", "cutoff", F.when(F.col("relevance_score") < F.col("cutoff"), "low-relevance").otherwise("include").alias("decision"))
