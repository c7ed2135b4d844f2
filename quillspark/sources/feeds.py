"""Atom feeds of preprints as candidates, read by Spark's XML reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text

NAME, LINK = "struct<name:string>", "struct<_href:string,_rel:string,_title:string,_type:string>"
ENTRY = f"id string, title string, summary string, published string, updated string, author array<{NAME}>, link array<{LINK}>, category array<struct<_term:string>>, `arxiv:primary_category` struct<_term:string>, `arxiv:doi` string, `arxiv:journal_ref` string"
#: How an entry's id ends: an identifier, old or new, and its version.
ENTRY_ID = r"/abs/((?:[a-z][a-z.\-]+/\d{7}|\d{4}\.\d{4,5}))(?:v(\d+))?$"


def entries(spark: SparkSession, path: str) -> DataFrame:
    """The entries of feed files, a row each, whatever stands around them."""
    return spark.read.format("xml").schema(ENTRY).option("rowTag", "entry").option("attributePrefix", "_").option("ignoreSurroundingSpaces", True).load(path)


def feed_candidates(found: DataFrame) -> DataFrame:
    """Entries as candidates: candidate_id, arxiv_id, version, title, abstract, authors, categories, published, updated, doi, url, pdf_url.

    Of several versions of an identifier the highest stays, of equal ones the one updated
    last. Entries whose id names none are left out.
    """
    none = F.array().cast("array<string>")
    names = F.array_compact(F.transform("author", lambda a: F.nullif(text.squeezed(a["name"]), F.lit(""))))
    terms = F.array_compact(F.array_distinct(F.concat(F.array(F.col("`arxiv:primary_category`._term")), F.coalesce(F.transform("category", lambda c: c["_term"]), none))))
    pdf = F.try_element_at(F.filter("link", lambda x: (x["_title"] == "pdf") | (x["_type"] == "application/pdf")), F.lit(1))["_href"]
    own = found.withColumn("arxiv_id", F.regexp_extract(F.lower(F.trim("id")), ENTRY_ID, 1)).where("arxiv_id <> ''")
    own = own.select(
        F.concat(F.lit("arXiv:"), "arxiv_id").alias("candidate_id"),
        "arxiv_id",
        F.coalesce(F.nullif(F.regexp_extract(F.lower(F.trim("id")), ENTRY_ID, 2), F.lit("")), F.lit("1")).cast("int").alias("version"),
        text.squeezed(F.coalesce("title", F.lit("Untitled"))).alias("title"),
        text.squeezed(F.coalesce("summary", F.lit(""))).alias("abstract"),
        F.coalesce(names, none).alias("authors"),
        terms.alias("categories"),
        F.substring("published", 1, 10).alias("published"),
        F.substring("updated", 1, 10).alias("updated"),
        F.nullif(text.doi_norm(F.col("`arxiv:doi`")), F.lit("")).alias("doi"),
        F.concat(F.lit("https://arxiv.org/abs/"), "arxiv_id").alias("url"),
        F.regexp_replace(F.coalesce(pdf, F.concat(F.lit("https://arxiv.org/pdf/"), "arxiv_id")), "^http://", "https://").alias("pdf_url"),
    )
    rest = [c for c in own.columns if c != "candidate_id"]
    best = own.groupBy("candidate_id").agg(F.max(F.struct("version", "updated", *[c for c in rest if c not in ("version", "updated")])).alias("_b"))
    return best.select("candidate_id", *[F.col(f"_b.{c}").alias(c) for c in rest])
