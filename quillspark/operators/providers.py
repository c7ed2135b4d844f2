"""Works of providers as candidates: projections, filters, quotas, queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.sources.files import reconstructed

# The schema of a provider's work as far as it is read, and the patterns of arXiv ids.
NODE = "struct<id:string,display_name:string>"
LOCATION = "struct<landing_page_url:string,pdf_url:string,is_oa:boolean,license:string,version:string,source:struct<display_name:string,type:string>>"
TOPIC = f"struct<id:string,display_name:string,subfield:{NODE},field:{NODE},domain:{NODE}>"
WORK = f"""id string, doi string, ids map<string,string>, arxiv_id string, title string, display_name string, abstract_inverted_index map<string,array<int>>, publication_year int, publication_date string,
type string, language string, cited_by_count long, authorships array<struct<author:struct<display_name:string>>>, topics array<{TOPIC}>, primary_topic {TOPIC}, open_access struct<is_oa:boolean,oa_status:string>,
best_oa_location {LOCATION}, primary_location {LOCATION}, locations array<{LOCATION}>, has_content struct<pdf:boolean>, content_urls struct<pdf:string>"""
ARXIV_BARE = r"^(?i)((?:[a-z][a-z.\-]+/\d{7}|\d{4}\.\d{4,5}))(?:v\d+)?$"
ARXIV_IN = r"(?i)(?:arxiv(?:\.org/(?:abs|pdf)/|:)|10\.48550/arxiv\.)((?:[a-z][a-z.\-]+/\d{7})|(?:\d{4}\.\d{4,5}))(?:v\d+)?"


def tail(url: Column) -> Column:
    """The last part of a URL that names something."""
    return F.regexp_extract(F.rtrim(url, F.lit("/")), r"([^/]*)$", 1)


def arxiv_id(values: Column) -> Column:
    """The first arXiv id in an array of ids and URLs, without its version."""
    one = lambda v: F.coalesce(F.nullif(F.regexp_extract(F.trim(v), ARXIV_BARE, 1), F.lit("")), F.nullif(F.regexp_extract(v, ARXIV_IN, 1), F.lit("")))
    return F.try_element_at(F.array_compact(F.transform(F.array_compact(values), one)), F.lit(1))


def open_locations() -> Column:
    """The open locations of a work that have a PDF, the best and primary ones first, each URL once."""
    everywhere = F.concat(F.array("best_oa_location", "primary_location"), F.coalesce("locations", F.array().cast(f"array<{LOCATION}>")))
    own = F.filter(everywhere, lambda x: (F.coalesce(x["pdf_url"], F.lit("")) != "") & F.coalesce(x["is_oa"], F.lit(False)))
    urls = F.transform(own, lambda x: x["pdf_url"])
    return F.filter(own, lambda x, i: F.array_position(urls, x["pdf_url"]) == i + 1)


def node(c: Column) -> Column:
    return F.when(F.coalesce(c["id"], F.lit("")) != "", F.struct(tail(c["id"]).alias("id"), F.coalesce(c["display_name"], F.lit("")).alias("display_name")))


def topic(c: Column) -> Column:
    own = F.struct(tail(c["id"]).alias("id"), F.coalesce(c["display_name"], F.lit("")).alias("display_name"), *[node(c[k]).alias(k) for k in ("subfield", "field", "domain")])
    return F.when(F.coalesce(c["id"], F.lit("")) != "", own)


def works(df: DataFrame) -> DataFrame:
    """Works (WORK, and any other columns) as flat records; those without an id are left out."""
    where = lambda x: [x["landing_page_url"], x["pdf_url"]]
    locations = F.coalesce(F.flatten(F.transform("locations", lambda x: F.array(*where(x)))), F.array().cast("array<string>"))
    said = F.concat(F.array("arxiv_id"), F.coalesce(F.map_values("ids"), F.array().cast("array<string>")), F.array("doi", *where(F.col("best_oa_location")), *where(F.col("primary_location"))), locations)
    names = F.array_compact(F.transform("authorships", lambda a: F.nullif(a["author"]["display_name"], F.lit(""))))
    labels = F.array_compact(F.transform(F.slice("topics", 1, 8), lambda t: F.nullif(t["display_name"], F.lit(""))))
    either = lambda k: F.coalesce(F.nullif(F.col(f"best_oa_location.{k}"), F.lit("")), F.nullif(F.col(f"primary_location.{k}"), F.lit("")))
    read = {c.strip().split(" ")[0] for c in ("id", "doi", "ids", "arxiv_id", "title", "display_name", "abstract_inverted_index", "authorships", "topics", "primary_topic", "open_access", "best_oa_location", "primary_location", "locations", "has_content", "content_urls")}
    rest = [c for c in df.columns if c not in read]
    return df.where("coalesce(id, '') <> ''").select(
        tail(F.col("id")).alias("openalex_id"),
        F.nullif(text.doi_norm(F.col("doi")), F.lit("")).alias("doi"),
        arxiv_id(said).alias("arxiv_id"),
        F.coalesce(F.nullif("title", F.lit("")), F.nullif("display_name", F.lit("")), F.lit("Untitled")).alias("title"),
        F.coalesce(reconstructed(F.col("abstract_inverted_index")), F.lit("")).alias("abstract"),
        F.coalesce(F.slice(names, 1, 12), F.array().cast("array<string>")).alias("authors"),
        F.coalesce(labels, F.array().cast("array<string>")).alias("topics"),
        topic(F.col("primary_topic")).alias("primary_topic"),
        F.coalesce(F.array_compact(F.transform("topics", topic)), F.array().cast(f"array<{TOPIC}>")).alias("topic_metadata"),
        F.coalesce("open_access.is_oa", F.lit(False)).alias("is_open_access"),
        F.col("open_access.oa_status").alias("open_access_status"),
        either("license").alias("license"),
        open_locations().alias("oa_locations"),
        (F.coalesce("has_content.pdf", F.lit(False)) | (F.coalesce("content_urls.pdf", F.lit("")) != "")).alias("has_openalex_pdf"),
        either("landing_page_url").alias("landing_page_url"),
        either("pdf_url").alias("pdf_url"),
        F.col("primary_location.source.display_name").alias("source"),
        *rest,
    )


def title_excluded(title: Column, prefixes: list[str]) -> Column:
    """Whether a title's key starts with that of any prefix."""
    key = text.title_key(title)
    return reduce(lambda a, p: a | key.startswith(text.title_key(F.lit(p))), prefixes, F.lit(False))


def excluded_titles(titles: DataFrame, prefixes: DataFrame, key: str = "id") -> DataFrame:
    """The ids of titles (id, title) whose key starts with that of any prefix (prefix), from a table of them.

    A title meets prefixes by its own starts, of the lengths that prefixes have; an empty
    prefix excludes all.
    """
    heads = prefixes.select(text.title_key(F.col("prefix")).alias("_p")).distinct()
    lengths = sorted(r[0] for r in heads.select(F.length("_p")).distinct().collect())  # no more than letters of the longest
    own = titles.select(key, text.title_key(F.col("title")).alias("_t"))
    starts = own.select(key, "_t", F.explode(F.array(*[F.lit(n) for n in lengths]).cast("array<int>")).alias("_n")).where(F.length("_t") >= F.col("_n"))
    return starts.select(key, F.substring(F.col("_t"), F.lit(1), F.col("_n")).alias("_p")).join(heads, "_p", "left_semi").select(key).distinct()


def candidates(records: DataFrame, prefixes: list[str], keyed: bool = False) -> DataFrame:
    """Flat records that can be fetched (an open PDF, an arXiv id, or with a key the provider's own copy) and whose title is not excluded, with their routes."""
    urls = F.transform(F.filter("oa_locations", lambda x: x["pdf_url"].rlike("^https?://")), lambda x: F.regexp_replace(x["pdf_url"], "^http://", "https://"))
    own = records.withColumn("_urls", urls).where(~title_excluded(F.col("title"), prefixes))
    own = own.where((F.size("_urls") > 0) | F.col("arxiv_id").isNotNull() | (F.lit(keyed) & F.col("has_openalex_pdf")))
    return own.select(
        F.concat(F.lit("OpenAlex:"), "openalex_id").alias("candidate_id"),
        *[c for c in records.columns if c not in ("oa_locations", "pdf_url")],
        F.coalesce(F.try_element_at("_urls", F.lit(1)), F.lit("")).alias("pdf_url"),
        F.when(F.size("_urls") > 1, F.slice("_urls", F.lit(2), F.size("_urls"))).otherwise(F.array().cast("array<string>")).alias("alternate_pdf_urls"),
    )


def quota(hits: DataFrame, limit: int) -> DataFrame:
    """The first `limit` different ids of each query in rank order (query, rank, openalex_id): what cursor paging collects."""
    first = hits.groupBy("query", "openalex_id").agg(F.min("rank").alias("rank"))
    nth = F.row_number().over(Window.partitionBy("query").orderBy("rank", "openalex_id"))
    return first.withColumn("nth", nth).where(F.col("nth") <= limit)


def primary_filter(records: DataFrame, level: str, ids: list[str]) -> DataFrame:
    """Records whose primary topic, or its domain, field or subfield, is one of the ids (bare or URLs)."""
    own = F.col("primary_topic.id") if level == "topic" else F.col(f"primary_topic.{level}.id")
    return records.where(own.isin([i.rstrip("/").rpartition("/")[2] for i in ids]))


def arxiv_query(phrases: Column, categories: Column, first_year: Column, last_year: Column) -> Column:
    """A query over titles and abstracts, categories and dates; null without a phrase or a category."""
    clean = F.filter(F.transform(phrases, lambda p: F.trim(F.regexp_replace(p, r'["\r\n]+', " "))), lambda p: p != "")
    said = F.array_join(F.transform(clean, lambda p: F.concat(F.lit('(ti:"'), p, F.lit('" OR abs:"'), p, F.lit('")'))), " OR ")
    of = F.array_join(F.transform(categories, lambda c: F.concat(F.lit("cat:"), c)), " OR ")
    dates = F.concat(F.lit("submittedDate:["), first_year.cast("string"), F.lit("01010000 TO "), last_year.cast("string"), F.lit("12312359]"))
    return F.when((F.size(clean) > 0) & (F.size(categories) > 0), F.concat(F.lit("("), said, F.lit(") AND ("), of, F.lit(") AND "), dates))
