"""The durable state of a learner: items, their sources, discoveries, briefs, papers, settings.

A table is a snapshot; an update is a batch of rows that gives the next snapshot, as if its
rows had been applied one after another in the order of `seq`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators.discovery import identity_keys

ITEM = "item_id string, item_type string, normalized_form string, display_form string, sense_key string, part_of_speech string, meaning_en string, meaning_zh string, domain_label string, confidence double, status string, card string, created_at timestamp, updated_at timestamp"
SOURCE = "source_key string, item_id string, domain_id string, paper_id string, source_title string, source_url string, context string, evidence_context_id string, added_at timestamp"
#: Texts of an item that its first encounter with a value fills; confidence and card are filled alike.
FILLED = ("part_of_speech", "meaning_en", "meaning_zh", "domain_label")


def plain(c: Column | str) -> Column:
    """Lower case, white space squeezed; null as empty."""
    return F.lower(text.squeezed(F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(""))))


def described(rows: DataFrame) -> DataFrame:
    """rows (item_type, display_form, meaning_zh, sense_key) with normalized_form, sense_key and item_id.

    The sense is the given one, else a term itself, else an id of the meaning.
    """
    sense = F.coalesce(F.nullif(plain("sense_key"), F.lit("")), F.when(F.col("item_type") == "term", plain("display_form")), text.stable_id(plain("meaning_zh")))
    out = rows.withColumn("normalized_form", plain("display_form")).withColumn("sense_key", sense)
    return out.withColumn("item_id", text.stable_id(F.col("item_type"), F.col("normalized_form"), F.col("sense_key")))


def refused(rows: DataFrame) -> DataFrame:
    """Encounters that cannot be registered: rows with violation."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    why = F.when(~F.col("item_type").isin("word", "term"), "no such item type").when(blank("display_form"), "no name")
    why = why.when(blank("meaning_zh") | blank("context") | blank("source_title") | blank("evidence_context_id"), "no meaning or evidence")
    why = why.when(~F.coalesce("status", F.lit("learning")).isin("learning", "mastered"), "no such status")
    return rows.withColumn("violation", why).where("violation is not null")


def upserted(items: DataFrame, encounters: DataFrame) -> DataFrame:
    """The items (ITEM) after encounters (seq, at, item_type, display_form, meaning_zh, sense_key, part_of_speech, meaning_en, domain_label, confidence, status, card).

    A new item is as its first encounter says. A known one keeps its name, status and card;
    its empty texts and null confidence take the first value that any encounter has.
    """
    own = described(encounters)
    value = {c: F.trim(F.coalesce(c, F.lit(""))) for c in FILLED}
    aggs = [F.min_by(F.struct("item_type", "normalized_form", F.trim("display_form").alias("display_form"), "sense_key", F.coalesce("status", F.lit("learning")).alias("status"), "card", "at"), "seq").alias("_new"), F.max_by("at", "seq").alias("_last")]
    aggs += [F.min_by(F.when(v != "", v), F.when(v != "", F.col("seq"))).alias(f"_{c}") for c, v in value.items()]
    aggs.append(F.min_by("confidence", F.when(F.col("confidence").isNotNull(), F.col("seq"))).alias("_confidence"))
    fresh = own.groupBy(F.col("item_id").alias("_id")).agg(*aggs)
    both = items.join(fresh, F.col("item_id") == F.col("_id"), "full_outer")
    put, met = F.col("item_id").isNull(), F.col("_id").isNotNull()
    kept = lambda c: F.when(put, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)
    fill = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), f"_{c}", F.lit("")).alias(c)
    return both.select(
        F.coalesce("item_id", "_id").alias("item_id"),
        *[kept(c) for c in ("item_type", "normalized_form", "display_form", "sense_key")],
        *[fill(c) for c in FILLED],
        F.coalesce("confidence", "_confidence").alias("confidence"),
        kept("status"),
        kept("card"),
        F.when(put, F.col("_new.at")).otherwise(F.col("created_at")).alias("created_at"),
        F.when(met, F.col("_last")).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def upserted_sources(sources: DataFrame, encounters: DataFrame) -> DataFrame:
    """The sources (SOURCE) after encounters: title, url and context are those of the last one with the same key, all else of the first."""
    own = described(encounters).withColumn("source_key", text.stable_id(F.col("item_id"), F.col("domain_id"), F.col("paper_id"), F.trim("evidence_context_id")))
    stay = F.struct("item_id", "domain_id", "paper_id", F.trim("evidence_context_id").alias("evidence_context_id"), F.col("at").alias("added_at"))
    last = F.struct(*[F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ("source_title", "source_url", "context")])
    fresh = own.groupBy(F.col("source_key").alias("_key")).agg(F.min_by(stay, "seq").alias("_s"), F.max_by(last, "seq").alias("_l"))
    both = sources.join(fresh, F.col("source_key") == F.col("_key"), "full_outer")
    out = [F.coalesce("source_key", "_key").alias("source_key")]
    out += [F.coalesce(c, f"_s.{c}").alias(c) for c in ("item_id", "domain_id", "paper_id")]
    out += [F.coalesce(f"_l.{c}", c).alias(c) for c in ("source_title", "source_url", "context")]
    return both.select(*out, F.coalesce("evidence_context_id", "_s.evidence_context_id").alias("evidence_context_id"), F.coalesce("added_at", "_s.added_at").alias("added_at"))


def status_of(rows: DataFrame, items: DataFrame) -> DataFrame:
    """rows (item_type, display_form, meaning_zh, sense_key, ...) with item_id and status, `new` where there is no item."""
    known = items.select(F.col("item_id").alias("_id"), F.col("status").alias("_status"))
    out = described(rows).join(known, F.col("item_id") == F.col("_id"), "left")
    return out.withColumn("status", F.coalesce("_status", F.lit("new"))).drop("_id", "_status")


def moved(items: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items after a log (seq, at, item_id, action: master or restore), and the moves that are refused, with why.

    Any known item may be mastered; only a mastered one is restored. A move looks at the
    status that the moves before it have left.
    """
    known = items.select("item_id", F.col("status").alias("_status"))
    own = log.join(known, "item_id", "left")
    before = F.lag("action").over(Window.partitionBy("item_id").orderBy("seq"))
    was = F.when(before == "master", "mastered").when(before == "restore", "learning").otherwise(F.col("_status"))
    why = F.when(F.col("_status").isNull(), "no such item").when((F.col("action") == "restore") & (was != "mastered"), "not mastered").when(~F.col("action").isin("master", "restore"), "no such action")
    judged = own.withColumn("violation", why)
    done = judged.where("violation is null").groupBy(F.col("item_id").alias("_id")).agg(F.max_by(F.struct("action", "at"), "seq").alias("_m"))
    status = F.when(F.col("_m.action") == "master", "mastered").when(F.col("_m.action") == "restore", "learning").otherwise(F.col("status"))
    after = items.join(done, F.col("item_id") == F.col("_id"), "left").withColumn("status", status).withColumn("updated_at", F.coalesce("_m.at", "updated_at"))
    return after.drop("_id", "_m"), judged.where("violation is not null").select("seq", "item_id", "action", "violation")


def refreshed(items: DataFrame, forms: DataFrame) -> DataFrame:
    """Items with the display forms (item_id, form) of a catalogue, and whether that changed them (_changed); empty forms count for nothing."""
    fresh = forms.where("trim(coalesce(form, '')) <> ''").groupBy(F.col("item_id").alias("_id")).agg(F.max(F.trim("form")).alias("_form"))
    both = items.join(fresh, F.col("item_id") == F.col("_id"), "left")
    changed = F.coalesce(F.col("_form") != F.col("display_form"), F.lit(False))
    return both.withColumn("_changed", changed).withColumn("display_form", F.coalesce("_form", "display_form")).drop("_id", "_form")


def mastered_forms(items: DataFrame) -> DataFrame:
    return items.where("item_type = 'word' and status = 'mastered'").select("normalized_form").distinct()


def counts(items: DataFrame, due: DataFrame, briefs: DataFrame) -> DataFrame:
    """One row: items being learned, mastered and due (as the queue shows them), and briefs."""
    status = items.agg(F.count_if(F.col("status") == "learning").alias("learning_count"), F.count_if(F.col("status") == "mastered").alias("mastered_count"))
    queue, shown = due.agg(F.count(F.lit(1)).alias("due_count")), briefs.agg(F.count(F.lit(1)).alias("brief_count"))
    return status.crossJoin(F.broadcast(queue)).crossJoin(F.broadcast(shown))  # one row each


def recorded(discoveries: DataFrame, candidates: DataFrame, at: Column) -> DataFrame:
    """Discoveries (identity, discovered_at, metadata, recommended_brief_id) after candidates (seq, identity, metadata).

    New ones are put in; known ones take the time and metadata unless a brief has
    recommended them. _changed tells which. Candidates without identity are left out.
    """
    fresh = candidates.where("trim(coalesce(identity, '')) <> ''").groupBy(F.trim("identity").alias("_id")).agg(F.max_by("metadata", "seq").alias("_metadata"))
    both = discoveries.join(fresh, F.col("identity") == F.col("_id"), "full_outer")
    take = F.col("_id").isNotNull() & F.col("recommended_brief_id").isNull()
    return both.select(
        F.coalesce("identity", "_id").alias("identity"),
        F.when(take, at).otherwise(F.col("discovered_at")).alias("discovered_at"),
        F.when(take, F.col("_metadata")).otherwise(F.col("metadata")).alias("metadata"),
        "recommended_brief_id",
        take.alias("_changed"),
    )


def pool(discoveries: DataFrame, scope: str | None = None) -> DataFrame:
    """Discoveries that no brief has recommended, of a scope if one is given, the latest first; first_discovered_at is the stored time."""
    own = discoveries.where("recommended_brief_id is null and coalesce(metadata, '{}') not in ('', '{}', 'null')")
    if scope is not None:
        own = own.where(F.coalesce(F.get_json_object("metadata", "$.discovery_scope_id"), F.lit("")) == scope)
    return own.select("identity", "metadata", F.col("discovered_at").alias("first_discovered_at")).orderBy(F.desc("first_discovered_at"), "identity")


def seen_keys(discoveries: DataFrame, scope: str | None = None) -> DataFrame:
    """Identity keys of all discoveries, of a scope if one is given."""
    own = discoveries
    if scope is not None:
        own = own.where(F.coalesce(F.get_json_object("metadata", "$.discovery_scope_id"), F.lit("")) == scope)
    field = lambda n: F.get_json_object("metadata", f"$.{n}")
    keys = identity_keys(field("doi"), field("arxiv_id"), field("title"), field("candidate_id"), field("source_url"))
    all_keys = F.array_append(keys, F.concat(F.lit("candidate:"), F.col("identity")))
    return own.select(F.explode(all_keys).alias("key")).distinct()


def imported(briefs: DataFrame, fresh: DataFrame) -> DataFrame:
    """Briefs (brief_id, created_at, payload) after an import of others, with what became of each (outcome).

    new; same: known with an equal payload, which is kept as it is; clash: known with another payload, refused.
    """
    own = fresh.select(F.col("brief_id").alias("_id"), F.col("created_at").alias("_at"), F.col("payload").alias("_payload"))
    both = briefs.join(own, F.col("brief_id") == F.col("_id"), "full_outer")
    outcome = F.when(F.col("_id").isNull(), "kept").when(F.col("brief_id").isNull(), "new").when(F.col("payload") == F.col("_payload"), "same").otherwise("clash")
    return both.select(F.coalesce("brief_id", "_id").alias("brief_id"), F.coalesce("created_at", "_at").alias("created_at"), F.coalesce("payload", "_payload").alias("payload"), outcome.alias("outcome"))


def recommended(discoveries: DataFrame, items: DataFrame) -> DataFrame:
    """Discoveries with the brief (brief_id) that has just recommended them as an item (item_id)."""
    own = items.groupBy(F.col("item_id").alias("_id")).agg(F.max("brief_id").alias("_brief"))
    return discoveries.join(own, F.col("identity") == F.col("_id"), "left").withColumn("recommended_brief_id", F.coalesce("_brief", "recommended_brief_id")).drop("_id", "_brief")


def preheated(papers: DataFrame, started: DataFrame) -> DataFrame:
    """Papers (paper_id, preheat_started_at) after starts (paper_id, at): the first time of each stays."""
    first = started.groupBy(F.col("paper_id").alias("_id")).agg(F.min("at").alias("_at"))
    return papers.join(first, F.col("paper_id") == F.col("_id"), "left").withColumn("preheat_started_at", F.coalesce("preheat_started_at", "_at")).drop("_id", "_at")


def registered(registry: DataFrame, entry: DataFrame) -> DataFrame:
    """A registry of domains (domain_id, workspace, label) after entries of that shape; violation tells of those that are refused.

    The same domain and workspace take the new label; a known id with another workspace, or a
    known workspace under another id, is a conflict.
    """
    own = entry.select(F.col("domain_id").alias("_id"), F.col("workspace").alias("_place"), F.col("label").alias("_label"))
    other = registry.select(F.col("workspace").alias("_taken"), F.col("domain_id").alias("_by"))
    judged = own.join(registry.select("domain_id", "workspace"), F.col("_id") == F.col("domain_id"), "left").join(other, F.col("_place") == F.col("_taken"), "left")
    why = F.when(F.col("workspace") != F.col("_place"), "id of another workspace").when(F.col("_by") != F.col("_id"), "workspace of another id")
    judged = judged.select("_id", "_place", "_label", why.alias("_why"))
    after = registry.join(judged.where("_why is null"), F.col("domain_id") == F.col("_id"), "full_outer")
    kept = after.select(F.coalesce("domain_id", "_id").alias("domain_id"), F.coalesce("workspace", "_place").alias("workspace"), F.coalesce("_label", "label").alias("label"), F.lit(None).cast("string").alias("violation"))
    bad = judged.where("_why is not null").select(F.col("_id").alias("domain_id"), F.col("_place").alias("workspace"), F.col("_label").alias("label"), F.col("_why").alias("violation"))
    return kept.union(bad)


def migrated(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of a one-time migration: none if its key is among the completed ones (migration_key)."""
    return rows.join(done.where(F.col("migration_key") == key).select(F.lit(1).alias("_done")).limit(1), F.lit(True), "left").where("_done is null").drop("_done")
