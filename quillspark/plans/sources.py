"""Queries over sources and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.plans.base import query, table
from quillspark.sources import files
from quillspark.streaming import reviews


def _without(sql: str) -> str:
    """SQL of a page without the elements that are not read."""
    for tag in ("script", "style", "noscript", "svg", "form", "nav", "footer"):
        sql = f"regexp_replace({sql}, '(?is)<{tag}(\\s[^>]*)?>.*?</{tag}\\s*>', '', 'g')"
    return sql


#: Readable text of well-formed pages, for the character references that the tables hold.
READABLE = f"""bare AS (SELECT page_id, html, regexp_replace({_without("regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', '', 'g')")}, '>\\s+<', '><', 'g') AS h FROM pages),
cut AS (SELECT page_id, html, regexp_replace(regexp_replace(h, '(?i)</?(p|h[1-6]|li|blockquote|article)(\\s[^>]*)?>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM bare),
plain AS (SELECT page_id, html, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&copy;', '©'), '&amp;', '&') AS t FROM cut),
readable AS (SELECT page_id, html, array_to_string(list_filter([trim(regexp_replace(x, '\\s+', ' ', 'g')) for x in string_split(t, chr(10))], lambda x: x <> ''), chr(10) || chr(10)) AS text FROM plain)"""


@query(f"WITH {READABLE} SELECT page_id, text FROM readable")
def html_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", files.html_text("html").alias("text"))


@query(f"WITH {READABLE} SELECT page_id, text, len(regexp_extract_all(text, '\\S+'))::INT AS word_count FROM readable WHERE octet_length(encode(html)) <= 104857600 AND len(regexp_extract_all(text, '\\S+')) >= 200")
def fetched_pages(spark, sf_dir):
    return files.fetched(table(spark, sf_dir, "pages"))


@query("""SELECT event_type, count(*) AS n, count(props) AS with_props, count(DISTINCT props) AS distinct_props, sum(length(props))::BIGINT AS chars FROM events GROUP BY ALL""")
def event_props(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("props").alias("with_props"), F.count_distinct("props").alias("distinct_props"), F.sum(F.length("props")).alias("chars"))


@query("SELECT event_id, json_keys(props::JSON)[1] AS first_key, len(json_keys(props::JSON))::INT AS n_keys FROM events WHERE props IS NOT NULL")
def json_props(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("props is not null")
    keys = F.json_object_keys("props")
    return e.select("event_id", F.try_element_at(keys, F.lit(1)).alias("first_key"), F.size(keys).alias("n_keys"))


@query("""SELECT doc_id AS candidate_id, (r - 1)::INT AS route_no, url FROM (SELECT doc_id, unnest(u) AS url, generate_subscripts(u, 1) AS r FROM
(SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN ['https://a/' || doc_id, 'https://b/' || source] ELSE ['https://a/' || doc_id] END AS u FROM documents))""")
def download_routes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    own = F.concat(F.lit("http://a/"), F.col("doc_id").cast("string"))
    more = F.when(F.col("doc_id") % 2 == 0, F.array(F.concat(F.lit("https://a/"), F.col("doc_id").cast("string")), F.concat(F.lit("http://b/"), "source"))).otherwise(F.array(own))
    return files.download_routes(d.select(F.col("doc_id").alias("candidate_id"), own.alias("pdf_url"), more.alias("alternate_urls")))


@query("SELECT doc_id, md5(text) AS abstract_digest, length(text) AS n FROM documents WHERE text IS NOT NULL")
def abstract_from_index(spark, sf_dir):
    """Whole texts from maps of their tokens to places; texts are dealt out once, by document."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id").select("doc_id", F.posexplode(F.split("text", " ")).alias("p", "t"))
    places = d.groupBy("doc_id", "t").agg(F.collect_list("p").alias("ps")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("t", "ps"))).alias("index"))
    made = places.select("doc_id", files.reconstructed(F.col("index")).alias("abstract"))
    return made.select("doc_id", F.md5("abstract").alias("abstract_digest"), F.length("abstract").cast("long").alias("n"))


@query("SELECT (row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1) // 40 + 1 AS batch, doc_id FROM documents")
def review_batches(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return files.batches(d, [F.desc("n_chars"), F.col("doc_id")]).select("batch", "doc_id")


@query()
def review_state_stream(spark, sf_dir):
    e = reviews.event_stream(spark, sf_dir)
    rating = F.when(F.col("event_id") % 5 == 0, "again").when(F.col("event_id") % 5 == 1, "hard").otherwise("good")
    log = e.select(F.col("user_id").alias("item_id"), F.col("event_id").alias("seq"), rating.alias("rating"), F.col("ts").cast("timestamp").alias("at"))
    return reviews.latest(reviews.drained(reviews.review_states(log), "reviews", "update"))


@query("SELECT DISTINCT user_id AS identity FROM events")
def discovery_stream_dedup(spark, sf_dir):
    e = reviews.event_stream(spark, sf_dir).select(F.col("user_id").alias("identity"), F.col("ts").cast("timestamp").alias("at"))
    return reviews.drained(reviews.first_discoveries(e, "identity", "at"), "discoveries", "append").select("identity")
