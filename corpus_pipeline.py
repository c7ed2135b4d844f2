"""A training-data pipeline over documents: reject, tell languages, deduplicate, mix, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and reread as the next stage's docs. All but the last keep the columns of documents,
whatever they are called. Rows are documents, whatever their ids: null and repeated doc_ids
are not merged, and every stage takes null, empty and very long texts and empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import langid, mixing, ngram_join, packing, toxicity
from quillspark.shared import dropped, written

#: A document goes as being of no language if its average word has less than this posterior in its own best language.
LEAST_SURE = 0.5


def _carried(docs: DataFrame) -> DataFrame:
    """doc_id, text and the other columns under names that no operator uses."""
    return docs.select(*[F.col(f"`{c}`").alias(c if c in ("doc_id", "text") else f"_column_{i}") for i, c in enumerate(docs.columns)])


def _restored(told: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again."""
    return told.select(*[F.col(c if c in ("doc_id", "text") else f"_column_{i}").alias(c) for i, c in enumerate(docs.columns)])


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a 64-bit hash of the whole row (_id): rows that are equal in every column have the same."""
    return docs.select(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def _taken(rows: DataFrame, picks: DataFrame) -> DataFrame:
    """The rows (_keyed) that picks (_id, rows, copies) name, `copies` times; of equal rows (rows > 1) together.

    A row and its pick meet by a shuffle at every size; equal rows are one before it.
    """
    distinct = rows.groupBy("_id").agg(F.min("_row").alias("_row")) if picks.where("rows > 1").limit(1).count() else rows
    return distinct.join(picks.hint("merge"), "_id").select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those whose toxicity score is 0.5 or more.

    Null and empty texts stay, whatever the score of no words is. Rows are judged one by one:
    repeated rows and null ids alike; an empty table stays empty. The classifier learns
    from labels of sf_dir and the texts of these documents.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    told = toxicity.score(_carried(docs), model)
    return _restored(told.where((F.col("predicted") == 0) | (F.coalesce("text", F.lit("")) == "")), docs)


def reject_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those of no language: null texts, texts without a letter, and texts whose words are unlikely in every language.

    The last have an average posterior of their words' own best languages below LEAST_SURE;
    so texts that mix languages stay. Rows are judged one by one, repeated rows and null ids
    alike; an empty table stays empty, and a table without a labelled text, of which no
    language can be learned, loses all its rows.
    """
    told = langid.identify(_carried(docs), langid.train(docs))
    return _restored(told.where((F.col("lang_pred") != "und") & (F.col("sure") >= LEAST_SURE)), docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the row of the smallest doc_id, a null id last, of several the least hash of the text, then of the row.

    Rows that are equal in every column are one. Others are documents: rows of null ids, and
    rows of one id with unlike texts, are compared by their texts like all. Texts without
    words link with nothing and stay. An empty table stays empty.
    """
    rows = _keyed(docs)
    found = ngram_join.join(rows.select(F.col("_id").alias("doc_id"), F.col("_row.text").alias("text")))
    named = rows.select("_id", F.col("_row.doc_id").alias("_doc"), F.xxhash64("_row.text").alias("_text")).distinct()
    ids = found.groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("rows")).join(named, F.col("doc_id") == F.col("_id"))
    first = F.min(F.struct(F.col("_doc").isNull().alias("null"), "_doc", "_text", "_id", "rows"))
    kept = ids.groupBy("component_id").agg(first.alias("_first")).select("_first._id", "_first.rows", F.lit(1).alias("copies"))
    return _taken(rows, written(kept, "kept"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, to the nearest whole number, 0 to 3 times.

    Rows of null and repeated ids are told apart by the whole row; equal rows are taken as
    often as the mix takes all of them. Texts without words have no size and go; an empty table stays empty.
    """
    rows = _keyed(docs)
    share = mixing.mix(rows.select("_id", "_row.doc_id", "_row.text", "_row.source"), carry=("_id",))
    copies = F.when(F.col("taken") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    picks = share.groupBy("_id").agg(F.count(F.lit(1)).alias("rows"), F.sum(copies).alias("copies")).where("copies > 0")
    return _taken(rows, written(picks, "picks"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in packed sequences; a null or empty text is the end id alone, an empty table gives no piece."""
    return packing.pack(docs, cached=100_000)  # workers of the stages before still hold memory


STAGES = [
    ("toxicity", reject_toxic),
    ("language_id", reject_unknown_language),
    ("ngram_join", one_of_each_group),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL expresses neither the classifiers nor the packing; tests/llm hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        then = written(stage(spark, docs, sf_dir), f"stage-{name}")
        dropped(docs)
        docs = then
    return STAGES[-1][1](spark, docs, sf_dir)
