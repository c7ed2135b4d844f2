"""Cleaning of academic text as operations over lines, ordered by their number."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text

# Headings and lines that steer the cleaning.
STOP_SECTION = r"^(?i)(?:\d+(?:\.\d+)*[.)]?\s+)?(?:references|bibliography|works cited)\s*$"
ACKNOWLEDGEMENT = r"^(?i)(?:\d+(?:\.\d+)*[.)]?\s+)?acknowledg(?:e)?ments?\s*$"
ABSTRACT = r"^(?i)\s*abstract\s*(?:[—–:\-]\s*)?(.*)$"
ABSTRACT_WITHIN = 180
EMAIL = r"\b[\w.+-]+@[\w.-]+\.\w+\b"
PAGE_NUMBER = r"^(?i)(?:page\s+)?\d+(?:\s+of\s+\d+)?$"


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, page, no and line of each normalised text: pages end with a form feed; no counts on over pages, both from 0."""
    page = lambda p, i: F.transform(F.split(p, "\n"), lambda x: F.struct(i.alias("page"), x.alias("line")))
    all_lines = F.flatten(F.transform(F.split(text.normalised(F.coalesce("text", F.lit(""))), "\f"), page))
    return docs.select("doc_id", F.posexplode(all_lines).alias("no", "_l")).select("doc_id", "_l.page", "no", "_l.line")


def margin_lines(lines: DataFrame, edge: int = 3, longest: int = 160) -> DataFrame:
    """Keys of lines that stand among the first or last lines of many pages of a document of three pages or more.

    lines: doc_id, page, no, line. Many: three and 40% of the pages at least.
    """
    some = lines.where(F.trim("line") != "")
    page = Window.partitionBy("doc_id", "page")
    some = some.withColumns({"_up": F.row_number().over(page.orderBy("no")), "_down": F.row_number().over(page.orderBy(F.desc("no")))})
    some = some.where(((F.col("_up") <= edge) | (F.col("_down") <= edge)) & (F.length(F.trim("line")) <= longest))
    keys = some.groupBy("doc_id", text.line_key(F.trim("line")).alias("key")).agg(F.count_distinct("page").alias("pages_with"))
    pages = lines.groupBy("doc_id").agg(F.count_distinct("page").alias("_pages"))
    out = keys.join(pages, "doc_id").where((F.col("_pages") >= 3) & (F.col("key") != ""))
    return out.where(F.col("pages_with") >= F.greatest(F.lit(3), F.ceil(F.col("_pages") * 0.4))).select("doc_id", "key", "pages_with")


def marked(lines: DataFrame) -> DataFrame:
    """The lines (doc_id, page, no, line), squeezed, with what the cleaning makes of each.

    gone: margin (lines repeated over pages, page numbers), numeric, before (the abstract, or
    a contact line where there is no abstract), after (references), thanks, caption (a
    repeated one), or null for lines of the body. The steps follow one another: each looks
    at what the ones before it have left.
    """
    doc = Window.partitionBy("doc_id")
    line = F.col("line")
    some = lines.withColumn("line", F.trim(F.regexp_replace("line", r"[ \t]+", " ")))
    margins = margin_lines(some).select(F.col("doc_id").alias("_doc"), F.col("key").alias("_margin"))
    some = some.join(margins, (F.col("doc_id") == F.col("_doc")) & (line != "") & (text.line_key(line) == F.col("_margin")), "left")
    early = F.when(line == "", F.lit(None)).when(F.col("_margin").isNotNull() | line.rlike(PAGE_NUMBER), "margin").when(text.mostly_numeric(line), "numeric")
    some = some.withColumn("gone", early.cast("string")).drop("_doc", "_margin")
    so_far = doc.orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    nth = F.sum(F.col("gone").isNull().cast("int")).over(so_far)
    head = F.col("gone").isNull() & line.rlike(ABSTRACT) & (F.col("_nth") <= ABSTRACT_WITHIN)
    some = some.withColumn("_nth", nth).withColumn("_head", F.min(F.when(head, F.col("no"))).over(doc))
    rest = F.trim(F.regexp_extract("line", ABSTRACT, 1))
    some = some.withColumn("line", F.when(F.col("no") == F.col("_head"), rest).otherwise(line))
    before = F.when(F.col("_head").isNotNull(), (F.col("no") < F.col("_head")) | (F.col("no") == F.col("_head")) & (line == "")).otherwise(line.rlike(EMAIL))
    some = some.withColumn("gone", F.coalesce("gone", F.when(before, "before")))
    stop = F.min(F.when(F.col("gone").isNull() & line.rlike(STOP_SECTION), F.col("no"))).over(doc)
    some = some.withColumn("_stop", stop).withColumn("gone", F.coalesce("gone", F.when(F.col("no") >= F.col("_stop"), "after")))
    event = F.when(F.col("gone").isNull(), F.when(line.rlike(ACKNOWLEDGEMENT), "on").when(text.is_heading(line), "off"))
    some = some.withColumn("_thanks", F.last(event, ignorenulls=True).over(so_far))
    some = some.withColumn("gone", F.coalesce("gone", F.when(F.col("_thanks") == "on", "thanks")))
    caption = F.when(F.col("gone").isNull() & line.rlike(text.CAPTION), text.line_key(F.regexp_replace("line", text.CAPTION, "")))
    some = some.withColumn("_caption", caption)
    again = F.row_number().over(Window.partitionBy("doc_id", "_caption").orderBy("no"))
    some = some.withColumn("gone", F.coalesce("gone", F.when(F.col("_caption").isNotNull() & (again > 1), "caption")))
    return some.select("doc_id", "page", "no", "line", "gone", "_head", "_stop")


def clean(lines: DataFrame) -> DataFrame:
    """The lines (doc_id, no, line) of the body of texts in lines (doc_id, page, no, line)."""
    return marked(lines).where("gone is null").select("doc_id", "no", "line")


def diagnostics(lines: DataFrame) -> DataFrame:
    """What the cleaning of each text found and removed."""
    return marked(lines).groupBy("doc_id").agg(
        F.count_distinct("page").alias("page_count"),
        (F.max("_head").isNotNull()).alias("abstract_heading_found"),
        (F.max("_stop").isNotNull()).alias("stopped_at_references"),
        F.count_if(F.col("gone") == "margin").alias("removed_repeated_margin_lines"),
        F.count_if(F.col("gone") == "numeric").alias("removed_numeric_lines"),
        F.count_if(F.col("gone") == "caption").alias("removed_duplicate_captions"),
    )


def body(cleaned: DataFrame) -> DataFrame:
    """doc_id, clean_text, body_word_count and low_extraction of cleaned lines."""
    joined = cleaned.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "line"))), lambda x: x["line"]), "\n").alias("t"))
    flat = F.regexp_replace(F.regexp_replace(text.dehyphenated(F.col("t")), r"[ \t]+", " "), r"\n{3,}", "\n\n")
    flat = F.regexp_replace(flat, r"^\s+|\s+$", "")
    return joined.select("doc_id", flat.alias("clean_text")).withColumns(
        {"body_word_count": text.word_count(F.col("clean_text")), "low_extraction": text.word_count(F.col("clean_text")) < 100}
    )
