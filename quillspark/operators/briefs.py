"""Briefs, cards and timelines: joins with fallbacks, ordered unions, first-per-key rules, audits, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators.ordering import numbered


def with_fallback(rows: DataFrame, cards: DataFrame) -> DataFrame:
    """rows (lemma, part_of_speech) with card_id: the card of lemma and part of speech, else the lemma's only card."""
    exact = cards.select(F.col("lemma").alias("_l"), F.col("part_of_speech").alias("_p"), F.col("card_id").alias("_exact"))
    only = cards.groupBy("lemma").agg(F.count(F.lit(1)).alias("_n"), F.min("card_id").alias("_only")).where("_n = 1").select(F.col("lemma").alias("_m"), "_only")
    out = rows.join(exact, (F.col("lemma") == F.col("_l")) & (F.col("part_of_speech") == F.col("_p")), "left").join(only, F.col("lemma") == F.col("_m"), "left")
    return out.withColumn("card_id", F.coalesce("_exact", "_only")).drop("_l", "_p", "_m", "_exact", "_only")


def first_per(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def ordered_union(key: str, order: str, *frames: DataFrame) -> DataFrame:
    """Rows of frames one after another, each key where it comes first: key, position."""
    both = None
    for i, df in enumerate(frames):
        own = df.select(F.col(key), F.struct(F.lit(i).alias("f"), F.col(order).alias("o")).alias("_at"))
        both = own if both is None else both.union(own)
    once = both.groupBy(key).agg(F.min("_at").alias("_at"))
    return numbered(once.select(key, "_at.f", "_at.o"), ["f", "o", key], "position").select(key, "position")


def page(df: DataFrame, order: list[Column | str], size: int, number: int) -> DataFrame:
    """Page `number` (from 1) of rows in an order."""
    return df.orderBy(*order).offset(size * (number - 1)).limit(size)


def unfamiliar(docs: DataFrame, unknown: DataFrame, most: int = 80) -> DataFrame:
    """The most frequent unknown words (lemma) of texts, each with its first sentence: lemma, n, context."""
    said = docs.select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("sent", "sentence"))
    held = said.select("doc_id", "sent", F.explode(text.words(F.col("sentence"))).alias("form")).select(F.lower("form").alias("lemma"), "doc_id", "sent")
    by = held.groupBy("lemma").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "sent")).alias("_at"))  # tasks add up before words meet
    top = by.join(unknown.select("lemma").distinct(), "lemma", "left_semi").orderBy(F.desc("n"), "lemma").limit(most)
    first = docs.join(F.broadcast(top.withColumn("doc_id", F.col("_at.doc_id"))), "doc_id")  # `most` rows
    sentence = F.get(text.sentences(F.col("text")), F.col("_at.sent"))
    return first.select("lemma", "n", sentence.alias("context")).orderBy(F.desc("n"), "lemma")


def brief_violations(items: DataFrame, low: int = 2, high: int = 5) -> DataFrame:
    """What is wrong with briefs' items (brief_id, item_id, url): number, ids, addresses."""
    by = items.groupBy("brief_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("item_id").alias("d"),
        F.count_if(~F.col("item_id").rlike("^[A-Za-z0-9][A-Za-z0-9._:-]*$")).alias("bad_id"),
        F.count_if(~F.col("url").rlike("^https?://[^/]+")).alias("bad_url"),
    )
    why = F.when(~F.col("n").between(low, high), "number of items").when(F.col("d") < F.col("n"), "repeated id").when(F.col("bad_id") > 0, "unsafe id").when(F.col("bad_url") > 0, "address")
    return by.select("brief_id", why.alias("violation")).where("violation is not null")


def timeline(attempts: DataFrame) -> DataFrame:
    """Phases (phase, attempt, started, finished in microseconds) rolled up: last attempt, first start, last finish, seconds at work and on the wall."""
    by = attempts.groupBy("phase").agg(F.max("attempt").alias("attempts"), F.min("started").alias("first"), F.max("finished").alias("last"), F.sum(F.col("finished") - F.col("started")).alias("_busy"))
    return by.select("phase", "attempts", F.round(F.col("_busy") / 1e6, 3).alias("busy_seconds"), F.round((F.col("last") - F.col("first")) / 1e6, 3).alias("wall_seconds"))


def provenance(words: DataFrame) -> DataFrame:
    """One row on what priors rest on: corpus size estimate, words with a level, with a tag, any adjustment."""
    return words.agg(
        F.max(F.floor(F.col("document_count") / F.col("document_share") + 0.5)).cast("long").alias("corpus_size"),
        F.count("cefr_level").alias("with_level"),
        F.count_if(F.size("exam_tags") > 0).alias("with_tag"),
        F.bool_or(F.col("education_adjustment") > 0).alias("adjusted"),
    )
