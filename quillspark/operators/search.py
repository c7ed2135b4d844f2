"""Search of names and texts as a search box does it, also in Han script, without nested loops.

What contains a word has its first letters: words and texts meet by runs of at most GRAM
letters. What is within k edits of a word has one of its k + 1 pieces whole (the pigeonhole
principle), so a window of a text is looked at only around a place where a piece stands.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text

GRAM = 3
#: Letters of a word up to which all its variants with two letters less are made; they grow with the square.
SPREAD = 40


def _compatible(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFKC", v))


def search_form(c: Column) -> Column:
    """Compatibility forms (NFKC), lower case, runs of other than letters and digits as one space."""
    return text.search_norm(F.pandas_udf(_compatible, "string")(F.coalesce(c, F.lit(""))))


def allowance(c: Column) -> Column:
    """Edits that a word of a query may have: 2 from eight letters on, 1 from four."""
    return F.when(F.length(c) >= 8, 2).when(F.length(c) >= 4, 1).otherwise(0)


def grams(df: DataFrame, column: str, sizes: Column) -> DataFrame:
    """df with _gram and _at (from 0) for each run of these many letters in a column."""
    n = F.length(column)
    cut = lambda k: F.transform(F.sequence(F.lit(0), n - k), lambda i: F.struct(F.substring(F.col(column), i + 1, k).alias("g"), i.alias("at")))
    every = F.flatten(F.transform(F.filter(sizes, lambda k: k <= n), cut))
    return df.withColumn("_g", F.explode(every)).select(*df.columns, F.col("_g.g").alias("_gram"), F.col("_g.at").alias("_at"))


def all_sizes() -> Column:
    return F.array(*[F.lit(k) for k in range(1, GRAM + 1)])


#: Letters of the beginnings by which words and texts meet: the longest that a word has.
SIZES = (1, 2, 3, 4, 6, 8, 12, 16)


def beginning(c: Column) -> Column:
    """The first letters of a word, as many as the largest of SIZES that it has."""
    out = F.lit(SIZES[0])
    for k in SIZES[1:]:
        out = F.when(F.length(c) >= k, k).otherwise(out)
    return F.substring(c, F.lit(1), out)


def containing(small: DataFrame, s: str, large: DataFrame, t: str) -> DataFrame:
    """Pairs (s, t) of distinct values where t contains s.

    They meet by the beginning of s. A value of t stands in for itself by a hash where it is
    spread over its runs of letters, and is fetched where one met; contains() then decides.
    """
    a = small.select(s).distinct().where(F.length(s) > 0).withColumn("_gram", beginning(F.col(s)))
    whole = large.select(t).distinct().where(F.col(t).isNotNull()).withColumn("_h", F.xxhash64(t))
    sizes = F.array(*[F.lit(k) for k in SIZES])
    n = F.length(t)
    cut = lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(F.col(t), i, k))
    every = F.array_distinct(F.flatten(F.transform(F.filter(sizes, lambda k: k <= n), cut)))
    b = whole.select("_h", F.explode(every).alias("_gram"))
    met = b.join(a, "_gram").select("_h", s)
    return met.join(whole, "_h").where(F.contains(F.col(t), F.col(s))).select(s, t)


def spread(words: DataFrame, column: str, distance: int, *keep: str) -> DataFrame:
    """Rows of words for each of their variants (_v) with up to `distance` letters deleted, for words of a bounded length."""
    out = F.array(F.col(column))
    for _ in range(distance):
        shorter = F.flatten(F.transform(out, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))))
        out = F.array_distinct(F.concat(out, shorter))
    return words.select(column, *keep, F.explode(out).alias("_v"))


def near_pairs(left: DataFrame, a: str, right: DataFrame, b: str, distance: int = 2) -> DataFrame:
    """Pairs (a, b) of distinct words within an edit distance.

    Words of at most SPREAD letters meet by their variants with letters deleted, longer ones
    by their pieces. A word of b that is longer than all of a by more than the distance is
    near none and is not spread out.
    """
    own, other = left.select(a).distinct(), right.select(b).distinct()
    longest = own.agg(F.coalesce(F.max(F.length(a)), F.lit(0)).alias("_most"))
    other = other.crossJoin(F.broadcast(longest)).where(F.length(b) <= F.col("_most") + distance).drop("_most")  # one row
    near = spread(own.where(F.length(a) <= SPREAD), a, distance).join(spread(other.where(F.length(b) <= SPREAD + distance), b, distance), "_v").select(a, b)
    long = own.where(F.length(a) > SPREAD).select(F.col(a).alias("q"))
    windows = near_windows(long, other.where(F.length(b) > SPREAD - distance).select(F.col(b).alias("compact")), F.lit(distance))
    near = near.union(windows.select(F.col("q").alias(a), F.col("compact").alias(b))).distinct()
    return near.where((F.abs(F.length(a) - F.length(b)) <= distance) & (F.levenshtein(a, b) <= distance))


def near_words(asked: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs (q, word) of an edit distance within the allowance of q."""
    near = near_pairs(asked.where(allowance(F.col("q")) > 0), "q", held, "word")
    return near.where((F.abs(F.length("word") - F.length("q")) <= allowance(F.col("q"))) & (F.levenshtein("word", "q") <= allowance(F.col("q"))))


def pieces(c: Column, k: Column) -> Column:
    """k + 1 neighbouring pieces of a word, as structs of place and text."""
    n = F.length(c)
    edge = lambda i: F.floor(n * i / (k + 1)).cast("int")
    return F.transform(F.sequence(F.lit(0), k), lambda i: F.struct(edge(i).alias("at"), F.substring(c, edge(i) + 1, edge(i + 1) - edge(i)).alias("piece")))


def near_windows(asked: DataFrame, texts: DataFrame, edits: Column | None = None) -> DataFrame:
    """Pairs (q, compact) where a text (compact) has a window within so many edits of q (its allowance): windows are shorter or longer by as much at most."""
    q = asked.select("q").distinct().withColumn("_k", allowance(F.col("q")) if edits is None else edits).where("_k > 0")
    q = q.withColumn("_p", F.explode(pieces(F.col("q"), F.col("_k")))).select("q", "_k", F.col("_p.at").alias("_off"), F.col("_p.piece").alias("_piece"))
    q = q.withColumn("_gram", F.substring("_piece", 1, GRAM))
    t = grams(texts.select("compact").distinct(), "compact", all_sizes())
    met = t.join(q, "_gram").where(F.substring(F.col("compact"), F.col("_at") + 1, F.length("_piece")) == F.col("_piece"))
    n, k = F.length("q"), F.col("_k")
    starts = F.sequence(F.greatest(F.lit(0), F.col("_at") - F.col("_off") - k), F.greatest(F.lit(0), F.col("_at") - F.col("_off") + k))
    sizes = F.sequence(F.greatest(F.lit(1), n - k), n + k)
    fits = lambda i, m: (i + m <= F.length("compact")) & (F.levenshtein(F.substring(F.col("compact"), i + 1, m), F.col("q")) <= k)
    return met.where(F.exists(starts, lambda i: F.exists(sizes, lambda m: fits(i, m)))).select("q", "compact").distinct()


def search(fields: DataFrame, queries: DataFrame, fuzzy_words: bool = True) -> DataFrame:
    """(query, id) of the items that a query finds: fields (id, text) are the texts of an item, queries (query) are as typed.

    After search_form(): an item is found if a field contains the query, or if each word of
    it is in some field: contained, within its allowance of edits of a word there, or, of a
    word with Han script, of a window of the field without its spaces. An empty query finds
    all items.
    """
    held = fields.select("id", search_form(F.col("text")).alias("field")).where("field <> ''").distinct()
    typed = queries.select("query").distinct().withColumn("_q", search_form(F.col("query")))
    blank = typed.where("_q = ''").select("query").crossJoin(fields.select("id").distinct())  # an empty query finds all items
    asked = typed.where("_q <> ''")
    names = held.select("field").distinct()
    whole = containing(asked.select(F.col("_q").alias("q")), "q", names, "field").join(asked.select("query", F.col("_q").alias("q")), "q").select("query", "field")
    tokens = asked.select("query", F.explode(F.array_distinct(F.split("_q", " "))).alias("q"))
    hits = [containing(tokens, "q", names, "field")]
    if fuzzy_words:
        words = names.select("field", F.explode(F.array_distinct(F.split("field", " "))).alias("word"))
        hits.append(near_words(tokens, words).join(words, "word").select("q", "field"))
    compact = names.withColumn("compact", F.replace("field", F.lit(" "), F.lit("")))
    han = tokens.where(F.col("q").rlike(r"\p{IsHan}"))
    hits.append(near_windows(han, compact).join(compact, "compact").select("q", "field"))
    met = hits[0]
    for h in hits[1:]:
        met = met.union(h)
    met = met.distinct().join(held, "field").select("q", "id").distinct().join(tokens, "q").select("query", "q", "id").distinct()
    needed = tokens.groupBy("query").agg(F.count(F.lit(1)).alias("_needed"))
    every = met.groupBy("query", "id").agg(F.count(F.lit(1)).alias("_found")).join(needed, "query").where("_found = _needed").select("query", "id")
    return whole.join(held, "field").select("query", "id").union(every).union(blank.select("query", "id")).distinct()


def library(items: DataFrame, queries: DataFrame, status: str | None = None) -> DataFrame:
    """(query, id) of items (id, status, fields) of a status, or of all, that a query finds."""
    own = items if status is None else items.where(F.col("status") == status)
    return search(own.select("id", F.explode("fields").alias("text")), queries)
