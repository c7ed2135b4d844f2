"""What a paper's page and the list of terms show: words with their sources and states, terms of the latest brief first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators.ordering import numbered


def judged_words(words: DataFrame, papers: DataFrame) -> DataFrame:
    """The words of papers with their paper's title and URL, and the first that is missing (violation), or null.

    words (paper_id, lemma, part_of_speech, meaning_zh, meaning_en, context,
    evidence_context_id, sense_key); papers (paper_id, title, source_url). Incomplete: without
    meaning, context, evidence or sense, or of no paper that is known.
    """
    own = words.withColumn("lemma", F.lower(F.trim("lemma"))).join(papers.select("paper_id", F.col("title").alias("source_title"), "source_url", F.lit(True).alias("_known")), "paper_id", "left")
    bare = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    why = F.when(F.col("_known").isNull(), "no such paper").when(bare("meaning_zh"), "no meaning").when(bare("context"), "no context").when(bare("evidence_context_id"), "no evidence").when(bare("sense_key"), "no sense")
    return own.withColumn("violation", why).drop("_known")


def paper_vocabulary(words: DataFrame, papers: DataFrame, statuses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The words that are complete, of judged_words(), with the reader's state; and those that are not (paper_id, lemma, violation).

    statuses (item_id, status), absent: new.
    """
    judged = judged_words(words, papers)
    item = text.stable_id(F.lit("word"), F.col("lemma"), F.lower(text.squeezed(F.col("sense_key"))))
    good = judged.where("violation is null").drop("violation").withColumn("item_id", item)
    good = good.join(statuses.select("item_id", "status"), "item_id", "left").withColumn("status", F.coalesce("status", F.lit("new")))
    return good, judged.where("violation is not null").select("paper_id", "lemma", "violation")


def used_papers(vocabulary: DataFrame, sources: DataFrame, papers: DataFrame) -> DataFrame:
    """Papers (paper_id, title) that a learned word (item_id) has a source (item_id, paper_id) in, with the number of such words."""
    met = vocabulary.select("item_id").distinct().join(sources.select("item_id", "paper_id").distinct(), "item_id").join(papers.select("paper_id", "title"), "paper_id")
    return met.groupBy("paper_id", "title").agg(F.count(F.lit(1)).alias("words"))


def term_list(terms: DataFrame, latest: DataFrame | None = None) -> DataFrame:
    """Terms (term, document_count, total_count) numbered as they are listed: those of the latest brief (term) first, if one is given, then by documents, occurrences, term."""
    own = terms.withColumn("in_latest", F.lit(False))
    if latest is not None:
        flag = latest.select(F.col("term").alias("_t"), F.lit(True).alias("_in")).distinct()
        own = terms.join(flag, F.col("term") == F.col("_t"), "left").withColumn("in_latest", F.coalesce("_in", F.lit(False))).drop("_t", "_in")
    return numbered(own, [(~F.col("in_latest")).cast("int"), F.desc("document_count"), F.desc("total_count"), F.col("term")], "place")
