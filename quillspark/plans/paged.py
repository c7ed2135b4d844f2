"""Queries over recorded pages and feeds that documents are written to, and over a table of prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import providers
from quillspark.operators.ordering import numbered
from quillspark.plans.base import query, table
from quillspark.shared import new_path, written
from quillspark.sources import feeds, paged

QUOTA, SINCE = 150, 2000
TITLE = "split_part(text, chr(10), 1)"
RANKED = f"""ranked AS (SELECT coalesce(source, '-') AS query_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::INT AS rank, 'W' || doc_id AS candidate_id, {TITLE} AS title, CASE WHEN lang = 'en' THEN '10.1/' || doc_id END AS doi, (1985 + n_chars % 40)::INT AS year FROM documents)"""


def recorded(spark, sf_dir) -> tuple[str, list[dict]]:
    """Documents as the recorded pages of a query for each source, in the order of their ids; and the queries."""
    docs = table(spark, sf_dir, "documents").withColumn("query_id", F.coalesce("source", F.lit("-")))
    placed = written(numbered(docs, ["query_id", "doc_id"], "number"), "placed")
    first = placed.groupBy("query_id").agg(F.min("number").alias("_first"))
    works = placed.join(F.broadcast(first), "query_id")  # a row per source, as many as queries
    title = F.element_at(F.split("text", "\n"), 1)
    folder = new_path(spark, "pages")
    paged.recorded(works.select("query_id", (F.col("number") - F.col("_first")).cast("int").alias("rank"), F.concat(F.lit("W"), "doc_id").alias("id"), title.alias("title"), F.when(F.col("lang") == "en", F.concat(F.lit("10.1/"), "doc_id")).alias("doi"), (1985 + F.col("n_chars") % 40).cast("int").alias("year")), folder)
    return folder, [{"id": r[0], "query": r[0]} for r in first.select("query_id").orderBy("query_id").collect()]


@query(f"WITH {RANKED} SELECT * FROM ranked WHERE rank < {QUOTA} AND year >= {SINCE} AND query_id <> (SELECT min(query_id) FROM ranked)")
def paged_candidates(spark, sf_dir):
    """Works of each source but the first, within its quota, of recent years: pages are read along cursors, by pushed filters."""
    folder, queries = recorded(spark, sf_dir)
    read = paged.read_paged(spark, folder, queries, QUOTA)
    return read.where(F.col("query_id").isin([q["id"] for q in queries[1:]]) & (F.col("year") >= SINCE))


@query(f"WITH {RANKED} SELECT query_id, 'ok' AS status, least(count(*), {QUOTA})::INT AS retained, least(count(*), ceil({QUOTA} / 100) * 100)::INT AS fetched, count(*)::INT AS total, {QUOTA} AS quota FROM ranked GROUP BY query_id")
def paged_attempts(spark, sf_dir):
    """How the reading of each source's pages went: none beyond the quota."""
    folder, queries = recorded(spark, sf_dir)
    return paged.read_paged(spark, folder, queries, QUOTA, "attempts").drop("message")


CLEAN = r"trim(regexp_replace({0}, '[^\p{{L}}\p{{N}}.,]+', ' ', 'g'))"


def in_feeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's lines between the first and the last one of a feed."""
    yield pa.record_batch([['<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom">']], names=["value"])
    yield from (pa.record_batch([b.column(0)], names=["value"]) for b in batches)
    yield pa.record_batch([["</feed>"]], names=["value"])


@query(f"""SELECT 'arXiv:' || lpad((doc_id // 100000)::VARCHAR, 4, '0') || '.' || lpad((doc_id % 100000)::VARCHAR, 5, '0') AS candidate_id, (1 + doc_id % 3)::INT AS version, CASE WHEN {CLEAN.format(TITLE)} = '' THEN '' ELSE {CLEAN.format(TITLE)} END AS title,
md5({CLEAN.format("coalesce(text, '')")}) AS abstract_digest, [coalesce(source, 'none'), coalesce(lang, 'none')]::VARCHAR AS authors, CASE WHEN doc_id % 2 = 0 THEN '10.1/' || doc_id END AS doi FROM documents""")
def feed_candidates(spark, sf_dir):
    """Documents written as entries of feeds, in up to three versions, and read back: the highest version of each."""
    d = table(spark, sf_dir, "documents")
    clean = lambda c: F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}.,]+", " "))
    ident = F.concat(F.lpad(F.floor(F.col("doc_id") / 100000).cast("string"), 4, "0"), F.lit("."), F.lpad((F.col("doc_id") % 100000).cast("string"), 5, "0"))
    versions = d.withColumn("_v", F.explode(F.sequence(F.lit(1), (1 + F.col("doc_id") % 3).cast("int"))))
    last = F.col("_v") == 1 + F.col("doc_id") % 3
    title = F.when(last, clean(F.element_at(F.split("text", "\n"), 1))).otherwise("an older title")
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), F.coalesce(c, F.lit("")), F.lit(f"</{name}>"))
    people = [tag("author", tag("name", F.coalesce(F.col(c), F.lit("none")))) for c in ("source", "lang")]
    doi = F.when(F.col("doc_id") % 2 == 0, tag("arxiv:doi", F.concat(F.lit("10.1/"), "doc_id"))).otherwise("")
    entry = F.concat(tag("id", F.concat(F.lit("http://arxiv.org/abs/"), ident, F.lit("v"), F.col("_v"))), tag("title", title), tag("summary", clean(F.coalesce("text", F.lit("")))), tag("updated", F.lit("2024-01-01T00:00:00Z")), *people, doi)
    folder = new_path(spark, "feeds")
    versions.select(tag("entry", entry).alias("value")).mapInArrow(in_feeds, "value string").write.text(folder)
    got = feeds.feed_candidates(feeds.entries(spark, folder))
    return got.select("candidate_id", "version", "title", F.md5("abstract").alias("abstract_digest"), F.concat(F.lit("["), F.array_join("authors", ", "), F.lit("]")).alias("authors"), "doi")


KEY = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""WITH p AS (SELECT DISTINCT {KEY.format("p_name")} AS p FROM part UNION SELECT {KEY.format("regexp_extract(text, '^[A-Za-z]+')")} FROM benchmark), t AS (SELECT doc_id AS id, {KEY.format(TITLE)} AS t FROM documents)
SELECT id FROM t WHERE EXISTS (SELECT 1 FROM p WHERE p <> '' AND starts_with(t, p))""")
def prefix_exclusions(spark, sf_dir):
    """Documents whose title starts with any of thousands of prefixes: names of parts and the first words of benchmark items."""
    heads = table(spark, sf_dir, "benchmark").select(F.regexp_extract("text", "^[A-Za-z]+", 0).alias("prefix"))
    prefixes = table(spark, sf_dir, "part").select(F.col("p_name").alias("prefix")).union(heads)
    titles: DataFrame = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.element_at(F.split("text", "\n"), 1).alias("title"))
    return providers.excluded_titles(titles, prefixes.where(text.title_key(F.col("prefix")) != ""))
