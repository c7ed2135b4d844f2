"""Readers and writers of the file formats that corpora and learning state come in."""

from __future__ import annotations

from html.parser import HTMLParser
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tags that end a line, and those whose content is not read.
BREAKS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote article".split())
SKIPPED = frozenset("script style noscript svg form nav footer".split())
LEVELS = ("A1", "A2", "B1", "B2")
EXAM_TAGS = ("gk", "cet4", "cet6")


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Whole-file JSON objects."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = False) -> DataFrame:
    """JSON lines, blank ones skipped; strict: a bad line fails, else its columns are null."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def read_tsv(spark: SparkSession, path: str, required: list[str], exact: bool = False) -> DataFrame:
    """Tab-separated text with a header that has (exact: that is) the required columns."""
    df = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    missing = [c for c in required if c not in df.columns]
    if missing or exact and df.columns != required:
        raise ValueError(f"columns {df.columns}, required {required}")
    return df


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """lemma (lower case), part_of_speech, meaning_en, meaning_zh; rows without lemma or meaning_zh are left out."""
    df = read_tsv(spark, path, ["lemma", "part_of_speech", "meaning_en", "meaning_zh"], exact=True)
    df = df.select([F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in df.columns]).withColumn("lemma", F.lower("lemma"))
    return df.where("lemma <> '' and meaning_zh <> ''")


def read_levels(spark: SparkSession, path: str) -> DataFrame:
    """The lowest known level of each headword."""
    df = read_tsv(spark, path, ["headword", "cefr"]).select(F.lower(F.trim("headword")).alias("lemma"), F.upper(F.trim("cefr")).alias("l"))
    return df.where(F.col("l").isin(*LEVELS) & (F.col("lemma") != "")).groupBy("lemma").agg(F.min("l").alias("cefr_level"))


def read_exam_tags(spark: SparkSession, path: str) -> DataFrame:
    """Known tags of each headword; the last row of a headword counts."""
    df = read_tsv(spark, path, ["headword", "tags"]).withColumn("_row", F.monotonically_increasing_id())
    tags = F.filter(F.split(F.trim("tags"), r"\s+"), lambda t: t.isin(*EXAM_TAGS))
    return df.groupBy(F.lower(F.trim("headword")).alias("lemma")).agg(F.max_by(tags, "_row").alias("exam_tags")).where("size(exam_tags) > 0")


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated text with a header; nested columns as compact JSON."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema]
    df.select(*flat).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with their keys in order."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


# Elements that begin and end a line, and those that are not read.
LINE_TAGS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "article")
UNREAD_TAGS = ("script", "style", "noscript", "svg", "form", "nav", "footer")


class _Events(HTMLParser):
    """A page as a list of (kind, value): open and close of a tag, and text with its character references resolved."""

    def reset(self) -> None:
        super().reset()
        self.events: list[tuple[str, str]] = []
        self.handle_starttag = lambda tag, attrs: self.events.append(("open", tag))
        self.handle_endtag = lambda tag: self.events.append(("close", tag))
        self.handle_data = lambda data: self.events.append(("text", data))


def _deeper(depth: int, event: tuple[str, str]) -> int:
    """How many unread elements are open after an event, if `depth` were before; the end of one that is not open counts for nothing."""
    kind, value = event
    if value not in UNREAD_TAGS or kind == "text":
        return depth
    return depth + 1 if kind == "open" else max(0, depth - 1)


def readable(page: str | None) -> str:
    """Text of a page outside unread elements: lines as its blocks make them, white space squeezed, a blank line between two."""
    parser = _Events()
    parser.feed(page or "")
    parser.close()
    depths = accumulate(parser.events, _deeper, initial=0)
    read = (event for event, depth in zip(parser.events, depths, strict=False) if depth == 0)
    said = "".join(value if kind == "text" else "\n" if value in LINE_TAGS else "" for kind, value in read if kind != "text" or not value.isspace())
    return "\n\n".join(filter(None, (" ".join(line.split()) for line in said.splitlines())))


def _all_readable(pages: pd.Series) -> pd.Series:
    return pages.map(readable)


def html_text(page: Column | str) -> Column:
    return F.pandas_udf(_all_readable, "string")(page)


def fetched(pages: DataFrame, least_words: int = 200, most_bytes: int = 100 << 20) -> DataFrame:
    """page_id, text, word_count of pages whose size and text pass the gates."""
    small = pages.where(F.octet_length("html") <= most_bytes)
    out = small.select("page_id", html_text("html").alias("text")).withColumn("word_count", F.regexp_count("text", F.lit(r"\S+")))
    return out.where(F.col("word_count") >= least_words)


def is_pdf(content: Column, most_bytes: int = 100 << 20) -> Column:
    """Whether binary content is a PDF of acceptable size, by its first bytes."""
    return (F.length(content) <= most_bytes) & (F.substring(content, 1, 5) == F.lit(b"%PDF-"))


def download_routes(candidates: DataFrame) -> DataFrame:
    """candidate_id, route_no, url: the primary URL, then alternates, each URL once, plain http made https."""
    https = lambda u: F.regexp_replace(u, "^http://", "https://")
    urls = F.array_distinct(F.array_compact(F.concat(F.array(https(F.col("pdf_url"))), F.transform("alternate_urls", https))))
    return candidates.select("candidate_id", F.posexplode(urls).alias("route_no", "url")).where("url <> ''")


def lanes(*frames: DataFrame) -> DataFrame:
    """Providers' frames one after another, in the given order as lane."""
    out = None
    for i, df in enumerate(frames):
        own = df.withColumn("lane", F.lit(i))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def reconstructed(index: Column) -> Column:
    """A text from a map of its tokens to their places."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("t")))))
    return F.array_join(F.transform(F.array_sort(places), lambda x: x["t"]), " ")


def batches(df: DataFrame, order: list[Column], size: int = 40) -> DataFrame:
    """df with batch, from 1: `size` rows each in the given order."""
    from quillspark.operators.ordering import numbered

    return numbered(df, order, "batch").withColumn("batch", F.ceil(F.col("batch") / size))

