"""Checks of reviewed card glosses, and of review batches before they become one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators.cards import means, semantic_phrase
from quillspark.operators.validation import blank, first_of

# Who reviews, and the version of a result.
REVIEWER, VERSION = "current-host-agent", 1


def plain(c: str):
    return F.lower(text.squeezed(F.coalesce(c, F.lit(""))))


def gloss_violations(candidates: DataFrame, glosses: DataFrame, drops: DataFrame) -> DataFrame:
    """lemma, violation: the first rule that the review of each lemma breaks.

    Every candidate (lemma, expansions, suggested_sense_key, dictionary of meaning_en and
    meaning_zh) is glossed (lemma, meaning_en, meaning_zh, sense_key, rationale) or dropped
    (lemma), once and nothing else is. A gloss has a meaning, a sense and a rationale. Where
    the corpus has one expansion of an acronym, sense and English meaning are its own, and the
    meaning is not copied from a dictionary entry that means something else.
    """
    said = glosses.groupBy(plain("lemma").alias("_g")).agg(F.count(F.lit(1)).alias("_glosses"), F.min(F.struct("meaning_en", "meaning_zh", "sense_key", "rationale")).alias("g"))
    gone = drops.groupBy(plain("lemma").alias("_d")).agg(F.count(F.lit(1)).alias("_drops"))
    own = candidates.withColumn("_c", plain("lemma")).select("_c", "expansions", "suggested_sense_key", "dictionary")
    both = own.join(said, F.col("_c") == F.col("_g"), "full_outer").join(gone, F.coalesce("_c", "_g") == F.col("_d"), "full_outer")
    glossed, dropped = F.col("_glosses").isNotNull(), F.col("_drops").isNotNull()
    one = F.coalesce(F.size("expansions") == 1, F.lit(False))
    expansion = F.try_element_at("expansions", F.lit(1))
    meaning = text.compact_gloss(F.col("g.meaning_zh"))
    copied = F.exists("dictionary", lambda d: (text.compact_gloss(d["meaning_zh"]) != "") & (text.compact_gloss(d["meaning_zh"]) == meaning) & ~means(d["meaning_en"], expansion))
    lemma = F.coalesce("_c", "_g", "_d")
    why = first_of(
        (lemma == "", "empty lemma"),
        ((F.col("_glosses") > 1) | (F.col("_drops") > 1), "decided twice"),
        (glossed & dropped, "glossed and dropped"),
        (F.col("_c").isNull(), "unknown"),
        (~glossed & ~dropped, "undecided"),
        (glossed & (meaning == ""), "no meaning"),
        (glossed & (plain("g.sense_key") == ""), "no sense"),
        (glossed & blank("g.rationale"), "no rationale"),
        (glossed & one & (plain("g.sense_key") != plain("suggested_sense_key")), "another sense than the expansion's"),
        (glossed & one & (semantic_phrase(text.compact_gloss(F.col("g.meaning_en"))) != semantic_phrase(expansion)), "another meaning than the expansion"),
        (glossed & one & F.coalesce(copied, F.lit(False)), "copied from another meaning"),
    )
    return both.select(lemma.alias("lemma"), why.alias("violation")).where("violation is not null")


def batch_violations(batches: DataFrame, candidates: DataFrame, results: DataFrame, decisions: DataFrame) -> DataFrame:
    """batch, lemma, violation of review batches that cannot become one.

    batches (batch, candidate_count); candidates (batch, lemma); results (batch,
    schema_version, reviewer, has_terminology, has_explanations); decisions (batch, lemma,
    kind: gloss or drop). The first batch brings the decisions on terms; no lemma is decided
    the same way in two batches.
    """
    own = batches.join(candidates.groupBy("batch").agg(F.count(F.lit(1)).alias("_n")), "batch", "left").join(results, "batch", "left")
    first = batches.agg(F.min("batch").alias("_first"))
    own = own.crossJoin(F.broadcast(first))  # one row
    told = F.coalesce(F.col("has_terminology") & F.col("has_explanations"), F.lit(False))
    why = first_of(
        (F.col("candidate_count") != F.coalesce("_n", F.lit(0)), "number of candidates"),
        (~F.coalesce((F.col("schema_version") == VERSION) & (F.col("reviewer") == REVIEWER), F.lit(False)), "identity of the result"),
        ((F.col("batch") == F.col("_first")) & ~told, "no decisions on terms"),
    )
    whole = own.select("batch", F.lit(None).cast("string").alias("lemma"), why.alias("violation")).where("violation is not null")
    again = decisions.groupBy("lemma", "kind").agg(F.count_distinct("batch").alias("_n"), F.max("batch").alias("batch")).where("_n > 1")
    return whole.union(again.select("batch", "lemma", F.lit("decided in two batches")))


def merged_counts(batches: DataFrame, candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row: batches, candidates, glosses and drops of the merged review."""
    kinds = decisions.agg(F.count_if(F.col("kind") == "gloss").alias("gloss_count"), F.count_if(F.col("kind") == "drop").alias("drop_count"))
    return batches.agg(F.count(F.lit(1)).alias("batch_count")).crossJoin(candidates.agg(F.count(F.lit(1)).alias("candidate_count"))).crossJoin(kinds)  # one row each
