"""Rules that a batch must keep before it is taken: each check gives the rows that break it, and gate() refuses a batch that has any."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators.store import plain

# What records may say.
SAFE_ID = r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,199}$"
ITEM_TYPES = ("new_paper", "recent_paper", "classic_paper", "backlog_paper", "public_report", "research_update")
SUPPLEMENTAL = ("public_report", "research_update")
REVIEWER, CANDIDATE_LIMITS = "current-host-agent", (50, 100, 150, 200)
LEVELS, TAGS = ("A1", "A2", "B1", "B2"), ("gk", "cet4", "cet6")


class Refused(ValueError):
    """A batch breaks a rule."""


def gate(violations: DataFrame, of: str, shown: int = 5) -> None:
    """Refuse a batch that has violations, naming a few."""
    bad = violations.limit(shown).collect()
    if bad:
        raise Refused(f"{of}: {[r.asDict() for r in bad]}")


def blank(c: str | Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def is_http(c: str | Column) -> Column:
    return F.coalesce(F.regexp(F.trim(c if isinstance(c, Column) else F.col(c)), F.lit("^https?://[^/?#]+")), F.lit(False))


def first_of(*rules: tuple[Column, str]) -> Column:
    """The label of the first rule that holds."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(label)) for c, label in rules])


def all_of(*rules: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(label)) for c, label in rules]))


def review_identity(reviews: DataFrame) -> DataFrame:
    """Reviews (id, schema_version, reviewer) of another schema than 1 or by another reviewer."""
    why = first_of((~F.col("schema_version").eqNullSafe(F.lit(1)), "schema version"), (~F.col("reviewer").eqNullSafe(F.lit(REVIEWER)), "reviewer"))
    return reviews.select("id", why.alias("violation")).where("violation is not null")


def selection(selected: DataFrame, packet: DataFrame, candidates: DataFrame) -> DataFrame:
    """Selected ids (candidate_id) that are repeated, outside the packet, or unknown."""
    per = selected.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("_n"))
    own = per.join(packet.select("candidate_id", F.lit(True).alias("_p")).distinct(), "candidate_id", "left").join(candidates.select("candidate_id", F.lit(True).alias("_c")).distinct(), "candidate_id", "left")
    why = first_of((F.col("_n") > 1, "repeated"), (F.col("_p").isNull(), "outside the packet"), (F.col("_c").isNull(), "unknown"))
    return own.select("candidate_id", why.alias("violation")).where("violation is not null")


def orthography(candidates: DataFrame, keeps: DataFrame, replacements: DataFrame, drops: DataFrame) -> DataFrame:
    """Lemmas that are not in exactly one of keeps, replacements (lemma, target) and drops, are no candidates, or whose target is not alphabetic."""
    none = F.lit(None).cast("string")
    said = keeps.select("lemma", none.alias("target")).union(replacements.select("lemma", "target")).union(drops.select("lemma", none))
    per = said.groupBy("lemma").agg(F.count(F.lit(1)).alias("_n"), F.max("target").alias("_target")).join(candidates.select("lemma", F.lit(True).alias("_c")).distinct(), "lemma", "full_outer")
    why = first_of((F.col("_c").isNull(), "unknown"), (F.col("_n").isNull(), "undecided"), (F.col("_n") > 1, "decided more than once"), (F.col("_target").isNotNull() & ~F.col("_target").rlike(r"^[a-z][a-z'-]*$"), "target is no word"))
    return per.select("lemma", why.alias("violation")).where("violation is not null")


def orthography_summary(summaries: DataFrame) -> DataFrame:
    """Summaries (id and five counts) whose counts are negative, missing or do not add up."""
    names = ("reviewed_candidate_count", "replacement_count", "drop_count", "explicit_keep_count", "unchanged_candidate_count")
    bad = reduce(lambda a, c: a | F.col(c).isNull() | (F.col(c) < 0), names, F.lit(False))
    adds = (F.col("explicit_keep_count") == F.col("unchanged_candidate_count")) & (F.col("reviewed_candidate_count") == F.col("replacement_count") + F.col("drop_count") + F.col("explicit_keep_count"))
    return summaries.select("id", first_of((bad, "no count"), (~adds, "does not add up")).alias("violation")).where("violation is not null")


def terminology(selected: DataFrame, candidates: DataFrame, explanations: DataFrame, papers: DataFrame) -> DataFrame:
    """What is wrong with selected terms (term, confidence): unknown, a confidence outside 0 to 1, no or an incomplete explanation, no evidence; and explanations of terms not selected.

    candidates: term, source_papers, examples of paper_id and sentence; explanations: term,
    meaning_en, meaning_zh, concept_role, sense_key; papers: paper_id.
    """
    known = papers.select("paper_id").distinct()
    loadable = candidates.select("term", "source_papers", F.explode_outer("examples").alias("e")).where(F.array_contains("source_papers", F.col("e.paper_id")) & ~blank(F.col("e.sentence")))
    loadable = loadable.select("term", F.col("e.paper_id").alias("paper_id")).join(known, "paper_id", "left_semi").select("term").distinct()
    told = explanations.select(plain("term").alias("_key"), (blank("meaning_en") | blank("meaning_zh") | blank("concept_role") | blank("sense_key")).alias("_short"))
    own = selected.withColumn("_k", plain("term")).join(candidates.select("term", F.lit(True).alias("_c")), "term", "left").join(loadable.withColumn("_e", F.lit(True)), "term", "left")
    both = own.join(told, F.col("_k") == F.col("_key"), "full_outer")
    why = first_of(
        (F.col("_k").isNull(), "explained but not selected"),
        (F.col("_c").isNull(), "unknown"),
        (F.col("confidence").isNull() | F.isnan("confidence") | ~F.col("confidence").between(0, 1), "confidence"),
        (F.col("_key").isNull(), "no explanation"),
        (F.col("_short"), "incomplete explanation"),
        (F.col("_e").isNull(), "no evidence"),
    )
    return both.select(F.coalesce("_k", "_key").alias("term"), why.alias("violation")).where("violation is not null")


def briefs(items: DataFrame) -> DataFrame:
    """What is wrong with briefs, by item (brief_id, item_id, title, source_url, value_reason, shadow_preview, item_type, vocabulary of lemma, context, evidence_context_id)."""
    missing = reduce(lambda a, c: a | blank(c), ("item_id", "title", "source_url", "value_reason", "shadow_preview"), F.lit(False))
    words = F.filter(F.coalesce("vocabulary", F.array().cast("array<struct<lemma:string,context:string,evidence_context_id:string>>")), lambda w: ~blank(w["lemma"]))
    per = items.groupBy("brief_id").agg(F.count(F.lit(1)).alias("_items"))
    twice = items.groupBy("brief_id", "item_id").agg(F.count(F.lit(1)).alias("_same"))
    own = items.join(per, "brief_id").join(twice, ["brief_id", "item_id"])
    why = all_of(
        (~F.col("_items").between(2, 5), "number of items"),
        (~F.col("brief_id").rlike(SAFE_ID), "unsafe brief id"),
        (missing, "missing text"),
        (F.col("_same") > 1, "repeated item"),
        (~blank("item_id") & ~F.col("item_id").rlike(SAFE_ID), "unsafe item id"),
        (~blank("source_url") & ~is_http("source_url"), "url"),
        (~F.coalesce(F.col("item_type").isin(*ITEM_TYPES), F.lit(False)), "item type"),
        (F.exists(words, lambda w: blank(w["context"])), "word without context"),
        (F.exists(words, lambda w: blank(w["evidence_context_id"])), "word without evidence"),
    )
    return own.select("brief_id", "item_id", F.explode(why).alias("violation")).distinct()


def provenance(items: DataFrame, prepared: DataFrame) -> DataFrame:
    """Brief items (item_id, title, source_url, item_type, vocabulary of lemma and context) that differ from what was prepared (the same columns)."""
    own = items.select(F.trim("item_id").alias("item_id"), *[F.trim(c).alias(c) for c in ("title", "source_url", "item_type")], F.col("vocabulary").alias("_words"))
    source = prepared.select(F.trim("item_id").alias("_id"), *[F.trim(c).alias(f"_{c}") for c in ("title", "source_url", "item_type")], F.map_from_entries(F.transform("vocabulary", lambda w: F.struct(F.lower(F.trim(w["lemma"])), F.trim(w["context"])))).alias("_contexts"))
    both = own.join(source, F.col("item_id") == F.col("_id"), "full_outer")
    context = lambda w: F.try_element_at(F.col("_contexts"), F.lower(F.trim(w["lemma"])))
    why = all_of(
        (F.col("_id").isNull(), "not prepared"),
        (F.col("item_id").isNull(), "missing"),
        *[(F.col(c) != F.col(f"_{c}"), f"changed {c}") for c in ("title", "source_url", "item_type")],
        (F.col("_id").isNotNull() & F.exists("_words", lambda w: context(w).isNull()), "word not grounded"),
        (F.exists("_words", lambda w: context(w) != F.trim(w["context"])), "changed context"),
    )
    return both.select(F.coalesce("item_id", "_id").alias("item_id"), F.explode(why).alias("violation"))


def supplemental(items: DataFrame) -> DataFrame:
    """Supplemental items (id, item_type, title, source_url, content_url, publication_date, venue) that break a rule; a URL counts once."""
    url = F.lower(F.rtrim(F.trim("source_url"), F.lit("/")))
    nth = F.row_number().over(Window.partitionBy(url).orderBy("id"))
    own = items.withColumn("_nth", nth)
    why = first_of(
        (~F.coalesce(F.trim("item_type").isin(*SUPPLEMENTAL), F.lit(False)), "item type"),
        (reduce(lambda a, c: a | blank(c), ("title", "source_url", "publication_date", "venue"), F.lit(False)), "missing text"),
        (~is_http("source_url") | ~blank("content_url") & ~is_http("content_url"), "url"),
        (F.try_to_timestamp(F.trim("publication_date")).isNull(), "date"),
        (F.col("_nth") > 1, "repeated url"),
    )
    return own.select("id", why.alias("violation")).where("violation is not null")


def word_statistics(words: DataFrame) -> DataFrame:
    """Rows of word statistics that a calibration does not take: their lemma and why. The number of rows is a rule of the batch (30 to 10,000)."""
    lemma = F.lower(F.trim(F.coalesce("lemma", F.lit(""))))
    again = words.groupBy(lemma.alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
    own = words.withColumn("_lemma", lemma).join(again, F.col("_lemma") == F.col("_l"))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    why = first_of(
        ((F.col("_lemma") == "") | (F.length("_lemma") > 128), "lemma"),
        (F.col("_n") > 1, "repeated lemma"),
        (blank("part_of_speech") | (F.length(F.trim("part_of_speech")) > 32), "part of speech"),
        (F.col("total_count").isNull() | (F.col("total_count") < 1) | F.col("document_count").isNull() | (F.col("document_count") < 1) | (F.col("document_count") > F.col("total_count")), "count"),
        (~finite("document_share") | (F.col("document_share") <= 0) | (F.col("document_share") > 1), "share"),
        (~finite("zipf") | ~F.col("zipf").between(0, 8), "zipf"),
        (F.col("cefr_level").isNotNull() & ~F.col("cefr_level").isin(*LEVELS), "level"),
        (F.col("exam_tags").isNull() | F.exists("exam_tags", lambda t: ~F.coalesce(t.isin(*TAGS), F.lit(False))), "tag"),
    )
    rows = own.select("lemma", why.alias("violation")).where("violation is not null")
    size = words.agg(F.count(F.lit(1)).alias("_n")).where(~F.col("_n").between(30, 10_000))
    return rows.union(size.select(F.lit(None).cast("string"), F.lit("number of words")))


def settings(rows: DataFrame) -> DataFrame:
    """Settings (section, time, weekday) that are none: a time other than HH:MM, a weekday of the weekly one outside 1 to 7."""
    time = ~F.coalesce(F.col("time").rlike(r"^([01]?\d|2[0-3]):[0-5]?\d$"), F.lit(False))
    why = first_of((~F.col("section").isin("weekly_brief", "daily_review"), "section"), (time, "time"), ((F.col("section") == "weekly_brief") & ~F.coalesce(F.col("weekday").between(1, 7), F.lit(False)), "weekday"))
    return rows.withColumn("violation", why).where("violation is not null")


def file_names(candidates: DataFrame) -> DataFrame:
    """File names that several candidates (candidate_id) would share."""
    named = candidates.select(text.file_id(F.col("candidate_id")).alias("file"), "candidate_id").distinct()
    return named.groupBy("file").agg(F.count(F.lit(1)).alias("candidates"), F.min("candidate_id").alias("first_id")).where("candidates > 1")


def prepared_selection(selections: DataFrame) -> DataFrame:
    """Selections (selection_id, candidate_id, keys) of other than 2 to 5 items, with a repeated id or two items that share an identity key."""
    size = selections.groupBy("selection_id").agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("candidate_id").alias("_ids"))
    shared = selections.select("selection_id", "candidate_id", F.explode(F.array_distinct("keys")).alias("key")).groupBy("selection_id", "key").agg(F.count_distinct("candidate_id").alias("_k"))
    shared = shared.groupBy("selection_id").agg(F.max("_k").alias("_most"))
    own = size.join(shared, "selection_id", "left")
    why = all_of((~F.col("_n").between(2, 5), "number of items"), (F.col("_ids") < F.col("_n"), "repeated id"), (F.col("_most") > 1, "one source twice"))
    return own.select("selection_id", F.explode(why).alias("violation"))


def profiles(rows: DataFrame) -> DataFrame:
    """What is wrong with research profiles (profile_id, version, confirmed, user_statement, research_summary, clarifications, search_queries, providers)."""
    asked, told = "search_queries", "clarifications"
    ids = F.filter(F.transform(asked, lambda q: q["id"]), lambda x: ~blank(x))
    why = all_of(
        (~F.col("version").eqNullSafe(F.lit(1)), "version"),
        (blank("profile_id"), "id"),
        (~F.col("confirmed").eqNullSafe(F.lit(True)), "not confirmed"),
        (blank("user_statement") | blank("research_summary"), "missing text"),
        (~F.coalesce(F.size(told).between(3, 4), F.lit(False)), "number of clarifications"),
        (F.exists(told, lambda c: blank(c["question"]) | blank(c["answer"])), "empty clarification"),
        (~F.coalesce(F.size(asked).between(3, 24), F.lit(False)), "number of queries"),
        (F.exists(asked, lambda q: blank(q["id"]) | blank(q["label"]) | blank(q["query"])), "empty query"),
        (F.size(F.array_distinct(ids)) < F.size(ids), "repeated query"),
        (F.exists(asked, lambda q: q["candidate_limit"].isNotNull() & ~q["candidate_limit"].isin(*CANDIDATE_LIMITS)), "candidate limit"),
        ((F.coalesce(F.size("providers"), F.lit(0)) < 1) | (F.size(F.array_distinct("providers")) < F.size("providers")) | F.exists("providers", lambda p: ~p.isin("openalex", "arxiv")), "providers"),
    )
    return rows.select("profile_id", F.explode(why).alias("violation"))


def batches(parts: DataFrame, results: DataFrame) -> DataFrame:
    """Review batches (batch, lemma) whose results (batch, lemma) miss lemmas, have others, or decide one in several batches."""
    done = results.groupBy("lemma").agg(F.count(F.lit(1)).alias("_n"), F.min("batch").alias("_in"))
    both = parts.select("lemma", "batch").join(done, "lemma", "full_outer")
    why = first_of((F.col("batch").isNull(), "unknown"), (F.col("_n").isNull(), "undecided"), (F.col("_n") > 1, "decided more than once"), (F.col("_in") != F.col("batch"), "decided in another batch"))
    return both.select("lemma", why.alias("violation")).where("violation is not null")


def registry(rows: DataFrame) -> DataFrame:
    """Ids and workspaces of a registry (domain_id, workspace, active) that are not unique, and whether one is active."""
    ids = rows.groupBy("domain_id").count().where("count > 1").select("domain_id", F.lit("repeated id").alias("violation"))
    places = rows.groupBy("workspace").agg(F.count(F.lit(1)).alias("n"), F.min("domain_id").alias("domain_id")).where("n > 1").select("domain_id", F.lit("repeated workspace"))
    active = rows.agg(F.count_if("active").alias("n"), F.count(F.lit(1)).alias("all")).where("n <> 1 and all > 0").select(F.lit(None).cast("string"), F.lit("not one active domain"))
    return ids.union(places).union(active)
