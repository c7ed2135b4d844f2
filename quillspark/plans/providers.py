"""Queries of providers' works, made of documents by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import providers
from quillspark.plans.base import query, table

TITLE = "trim(split_part(coalesce(text, ''), chr(10), 1))"
WORKS = f"""w AS (SELECT doc_id, 'W' || doc_id AS openalex_id, CASE doc_id % 4 WHEN 0 THEN '10.1/' || doc_id WHEN 1 THEN '10.2/A' || doc_id WHEN 2 THEN '10.48550/arXiv.2401.' || lpad((doc_id % 10000)::VARCHAR, 5, '0') || 'v2' END AS doi,
  CASE WHEN doc_id % 4 = 2 THEN '2401.' || lpad((doc_id % 10000)::VARCHAR, 5, '0') WHEN doc_id % 6 = 0 THEN 'cs/0101' || lpad((doc_id % 1000)::VARCHAR, 3, '0') WHEN doc_id % 10 = 1 THEN '1912.' || lpad((doc_id % 1000)::VARCHAR, 4, '0') END AS arxiv_id,
  CASE WHEN doc_id % 8 = 3 THEN 'Untitled' WHEN {TITLE} = '' THEN 'Untitled' ELSE {TITLE} END AS title, least(12, doc_id % 15) AS authors, CASE WHEN doc_id % 3 = 0 THEN 'cc-by' WHEN doc_id % 3 = 1 THEN 'cc0' END AS license,
  (list_filter([CASE WHEN doc_id % 3 = 0 THEN 'http://a.org/' || doc_id END, CASE WHEN doc_id % 2 = 0 THEN 'https://b.org/' || doc_id END, CASE WHEN doc_id % 5 = 0 THEN 'ftp://c.org/x' END], lambda x: x IS NOT NULL)) AS urls,
  doc_id % 7 = 0 AS has_pdf, 'T' || (doc_id % 20) AS topic, 'F' || (doc_id % 5) AS field FROM documents)"""


def work_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    s = lambda c: c.cast("string")
    none = F.lit(None).cast("string")
    doi = F.when(d % 4 == 0, F.concat(F.lit("https://doi.org/10.1/"), s(d))).when(d % 4 == 1, F.concat(F.lit("doi:10.2/A"), s(d))).when(d % 4 == 2, F.concat(F.lit("10.48550/arXiv.2401."), F.lpad(s(d % 10000), 5, "0"), F.lit("v2")))

    def place(url, when, license):
        return F.struct(none.alias("landing_page_url"), F.when(when, url).alias("pdf_url"), F.lit(True).alias("is_oa"), license.alias("license"), none.alias("version"), F.struct(F.lit("src").alias("display_name"), F.lit("journal").alias("type")).alias("source")).cast(providers.LOCATION)

    a, b = F.concat(F.lit("http://a.org/"), s(d)), F.concat(F.lit("https://b.org/"), s(d))
    old = F.when(d % 10 == 1, F.concat(F.lit("https://arxiv.org/abs/1912."), F.lpad(s(d % 1000), 4, "0"), F.lit("v1")))
    more = F.array(place(b, d % 2 == 0, none), place(F.lit("ftp://c.org/x"), d % 5 == 0, none), F.struct(old.alias("landing_page_url"), none.alias("pdf_url"), F.lit(False).alias("is_oa"), none.alias("license"), none.alias("version"), F.lit(None).cast("struct<display_name:string,type:string>").alias("source")).cast(providers.LOCATION))
    tagged = lambda p, k: F.struct(F.concat(F.lit("https://x.org/"), F.lit(p), s(d % k)).alias("id"), F.lit(p).alias("display_name"))
    own_topic = F.struct(F.concat(F.lit("https://x.org/T"), s(d % 20)).alias("id"), F.lit("t").alias("display_name"), F.lit(None).cast(providers.NODE).alias("subfield"), tagged("F", 5).alias("field"), F.lit(None).cast(providers.NODE).alias("domain"))
    title = F.trim(F.element_at(F.split(F.coalesce("text", F.lit("")), "\n"), 1))
    authors = F.transform(F.sequence(F.lit(0), F.lit(14)), lambda i: F.struct(F.struct(F.when(i < d % 15, F.concat(F.lit("n"), s(i))).alias("display_name")).alias("author")))
    old_id = F.when((d % 6 == 0) & (d % 4 != 2), F.concat(F.lit("cs/0101"), F.lpad(s(d % 1000), 3, "0"), F.lit("v3")))
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("https://openalex.org/W"), s(d)).alias("id"), doi.alias("doi"), F.create_map(F.lit("openalex"), F.concat(F.lit("W"), s(d))).alias("ids"), old_id.alias("arxiv_id"),
        F.when(d % 8 == 3, "").otherwise(title).alias("title"), none.alias("display_name"), F.lit(None).cast("map<string,array<int>>").alias("abstract_inverted_index"), authors.alias("authorships"), F.array(own_topic).alias("topics"), own_topic.alias("primary_topic"),
        F.struct(F.lit(True).alias("is_oa"), F.lit("gold").alias("oa_status")).alias("open_access"), place(a, d % 3 == 0, F.when(d % 3 == 0, "cc-by").otherwise("")).alias("best_oa_location"), place(a, d % 3 == 0, F.when(d % 3 == 1, "cc0")).alias("primary_location"), more.alias("locations"),
        F.struct((d % 7 == 0).alias("pdf")).alias("has_content"), F.struct(none.alias("pdf")).alias("content_urls"), "doc_id",
    )


@query(f"""WITH {WORKS} SELECT openalex_id, doi, arxiv_id, title, authors::INT AS n_authors, license, array_to_string(urls, ' ') AS urls, has_pdf AS has_openalex_pdf, topic, field FROM w""")
def provider_works(spark, sf_dir):
    r = providers.works(work_table(spark, sf_dir))
    urls = F.array_join(F.transform("oa_locations", lambda x: x["pdf_url"]), " ")
    return r.select("openalex_id", "doi", "arxiv_id", "title", F.size("authors").alias("n_authors"), "license", urls.alias("urls"), "has_openalex_pdf", F.col("primary_topic.id").alias("topic"), F.col("primary_topic.field.id").alias("field"))


KEPT = f"""{WORKS}, r AS (SELECT *, list_filter([replace(u, 'http://', 'https://') for u in urls], lambda u: starts_with(u, 'https://')) AS https FROM w),
kept AS (SELECT * FROM r WHERE NOT (starts_with(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), 'untitled')) AND (len(https) > 0 OR arxiv_id IS NOT NULL OR has_pdf))"""


@query(f"WITH {KEPT} SELECT 'OpenAlex:' || openalex_id AS candidate_id, coalesce(https[1], '') AS pdf_url, array_to_string(https[2:], ' ') AS alternates FROM kept")
def provider_candidates(spark, sf_dir):
    c = providers.candidates(providers.works(work_table(spark, sf_dir)), ["Untitled!"], keyed=True)
    return c.select("candidate_id", "pdf_url", F.array_join("alternate_pdf_urls", " ").alias("alternates"))


@query(f"WITH {WORKS} SELECT openalex_id FROM w WHERE field IN ('F1', 'F3')")
def provider_primary_filter(spark, sf_dir):
    return providers.primary_filter(providers.works(work_table(spark, sf_dir)), "field", ["https://x.org/F1", "F3"]).select("openalex_id")


@query("""WITH h AS (SELECT coalesce(source, '-') AS query, doc_id AS rank, 'W' || (doc_id % 70) AS openalex_id FROM documents), f AS (SELECT query, openalex_id, min(rank) AS rank FROM h GROUP BY ALL)
SELECT query, openalex_id, rank, nth FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank, openalex_id)::INT AS nth FROM f) WHERE nth <= 25""")
def provider_quota(spark, sf_dir):
    hits = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("-")).alias("query"), F.col("doc_id").alias("rank"), F.concat(F.lit("W"), (F.col("doc_id") % 70).cast("string")).alias("openalex_id"))
    return providers.quota(hits, 25)


@query("""SELECT p_partkey, '((ti:"' || p_name || '" OR abs:"' || p_name || '") OR (ti:"' || p_type || '" OR abs:"' || p_type || '")) AND (cat:cs.' || p_size || ') AND submittedDate:[' || (2000 + p_size) || '01010000 TO 202512312359]' AS q FROM part""")
def arxiv_queries(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    phrases = F.array(F.concat(F.lit('"'), "p_name", F.lit("\n")), F.col("p_type"), F.lit(' "" '))
    q = providers.arxiv_query(phrases, F.array(F.concat(F.lit("cs."), F.col("p_size").cast("string"))), 2000 + F.col("p_size"), F.lit(2025))
    return p.select("p_partkey", q.alias("q"))
