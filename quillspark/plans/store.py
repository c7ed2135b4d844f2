"""Queries of the learner's state, over made-up encounters and discoveries from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import store
from quillspark.plans.base import query, table

SID = "left(sha256({0}), 32)"
# An event is an encounter of a word (its user) or term; every fourth one has no part of speech, and so on.
ENC = f"""enc0 AS (SELECT event_id AS seq, ts AS tm, CASE WHEN user_id % 3 = 0 THEN 'term' ELSE 'word' END AS item_type, 'Form ' || (user_id % 400) AS display_form, 'm' || (user_id % 400) AS meaning_zh,
  CASE WHEN user_id % 5 = 0 THEN 'Sense ' || (user_id % 40) ELSE '' END AS sense, CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type END AS part_of_speech, CASE WHEN event_id % 3 = 0 THEN 'en ' || event_id ELSE ' ' END AS meaning_en,
  CASE WHEN event_id % 6 = 0 THEN 'domain' ELSE '' END AS domain_label, CASE WHEN event_id % 7 = 0 THEN event_id::DOUBLE END AS confidence, 'd' || (user_id % 2) AS domain_id, 'p' || (event_id % 50) AS paper_id,
  'title ' || event_id AS source_title, 'https://x.org/' || event_id AS source_url, ' ctx ' || event_id || ' ' AS context, 'e' || (event_id % 10) AS evidence_context_id FROM events),
enc1 AS (SELECT *, lower(display_form) AS normalized_form, CASE WHEN sense <> '' THEN lower(sense) WHEN item_type = 'term' THEN lower(display_form) ELSE {SID.format('lower(meaning_zh)')} END AS sense_key FROM enc0),
enc AS (SELECT *, {SID.format("item_type || chr(31) || normalized_form || chr(31) || sense_key")} AS item_id FROM enc1),
items AS (SELECT item_id, arg_min(item_type, seq) AS item_type, arg_min(normalized_form, seq) AS normalized_form, arg_min(display_form, seq) AS display_form, arg_min(sense_key, seq) AS sense_key,
  coalesce(arg_min(trim(part_of_speech), seq) FILTER (trim(part_of_speech) <> ''), '') AS part_of_speech, coalesce(arg_min(trim(meaning_en), seq) FILTER (trim(meaning_en) <> ''), '') AS meaning_en, arg_min(meaning_zh, seq) AS meaning_zh,
  coalesce(arg_min(domain_label, seq) FILTER (domain_label <> ''), '') AS domain_label, arg_min(confidence, seq) FILTER (confidence IS NOT NULL) AS confidence, epoch_us(arg_min(tm, seq)) AS created_at, epoch_us(arg_max(tm, seq)) AS updated_at FROM enc GROUP BY item_id)"""


def encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    s = lambda c: c.cast("string")
    return table(spark, sf_dir, "events").select(
        e.alias("seq"),
        F.col("ts").cast("timestamp").alias("at"),
        F.when(u % 3 == 0, "term").otherwise("word").alias("item_type"),
        F.concat(F.lit("Form "), s(u % 400)).alias("display_form"),
        F.concat(F.lit("m"), s(u % 400)).alias("meaning_zh"),
        F.when(u % 5 == 0, F.concat(F.lit("Sense "), s(u % 40))).otherwise("").alias("sense_key"),
        F.when(e % 4 == 0, "").otherwise(F.col("event_type")).alias("part_of_speech"),
        F.when(e % 3 == 0, F.concat(F.lit("en "), s(e))).otherwise(" ").alias("meaning_en"),
        F.when(e % 6 == 0, "domain").otherwise("").alias("domain_label"),
        F.when(e % 7 == 0, e.cast("double")).alias("confidence"),
        F.concat(F.lit("d"), s(u % 2)).alias("domain_id"),
        F.concat(F.lit("p"), s(e % 50)).alias("paper_id"),
        F.concat(F.lit("title "), s(e)).alias("source_title"),
        F.concat(F.lit("https://x.org/"), s(e)).alias("source_url"),
        F.concat(F.lit(" ctx "), s(e), F.lit(" ")).alias("context"),
        F.concat(F.lit("e"), s(e % 10)).alias("evidence_context_id"),
        F.lit("learning").alias("status"),
        F.lit(None).cast("string").alias("card"),
    )


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The encounters in two batches, of which the second has the later seq."""
    e = encounters(spark, sf_dir)
    middle = e.agg(F.percentile("seq", F.lit(0.5)).alias("m"))
    both = e.crossJoin(F.broadcast(middle))  # one row
    return both.where("seq <= m").drop("m"), both.where("seq > m").drop("m")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = halves(spark, sf_dir)
    return store.upserted(store.upserted(spark.createDataFrame([], store.ITEM), one), two)


@query(f"WITH {ENC} SELECT * FROM items")
def learning_upsert(spark, sf_dir):
    """Items after two batches of encounters: the second finds those of the first."""
    out = items(spark, sf_dir).drop("status", "card")
    return out.withColumns({c: F.unix_micros(c) for c in ("created_at", "updated_at")})


@query(f"""WITH {ENC}, k AS (SELECT *, {SID.format("item_id || chr(31) || domain_id || chr(31) || paper_id || chr(31) || evidence_context_id")} AS source_key FROM enc)
SELECT source_key, arg_min(item_id, seq) AS item_id, arg_min(domain_id, seq) AS domain_id, arg_min(paper_id, seq) AS paper_id, arg_max(source_title, seq) AS source_title, arg_max(source_url, seq) AS source_url,
  arg_max(trim(context), seq) AS context, arg_min(evidence_context_id, seq) AS evidence_context_id, epoch_us(arg_min(tm, seq)) AS added_at FROM k GROUP BY source_key""")
def learning_sources_upsert(spark, sf_dir):
    one, two = halves(spark, sf_dir)
    out = store.upserted_sources(store.upserted_sources(spark.createDataFrame([], store.SOURCE), one), two)
    return out.withColumn("added_at", F.unix_micros("added_at"))


MOVES = f"""{ENC}, moves AS (SELECT event_id AS seq, {SID.format("CASE WHEN user_id % 3 = 0 THEN 'term' ELSE 'word' END || chr(31) || 'form ' || (user_id % 400) || chr(31) || CASE WHEN user_id % 5 = 0 THEN 'sense ' || (user_id % 40) WHEN user_id % 3 = 0 THEN 'form ' || (user_id % 400) ELSE left(sha256('m' || (user_id % 400)), 32) END")} AS item_id,
  CASE WHEN event_id % 2 = 0 THEN 'master' ELSE 'restore' END AS action FROM events WHERE event_id % 11 = 0 UNION ALL SELECT -1, 'nobody', 'master'),
j AS (SELECT m.*, i.item_id IS NOT NULL AS known, lag(action) OVER (PARTITION BY m.item_id ORDER BY seq) AS before FROM moves m LEFT JOIN items i USING (item_id)),
v AS (SELECT *, CASE WHEN NOT known THEN 'no such item' WHEN action = 'restore' AND coalesce(before, 'none') <> 'master' THEN 'not mastered' END AS violation FROM j),
after AS (SELECT i.*, coalesce(s, 'learning') AS status FROM items i LEFT JOIN (SELECT item_id, CASE arg_max(action, seq) WHEN 'master' THEN 'mastered' ELSE 'learning' END AS s FROM v WHERE violation IS NULL GROUP BY item_id) USING (item_id))"""


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = store.described(encounters(spark, sf_dir)).where("seq % 11 = 0")
    action = F.when(F.col("seq") % 2 == 0, "master").otherwise("restore")
    nobody = spark.range(1).select(F.lit(-1).cast("long"), F.lit(None).cast("timestamp"), F.lit("nobody"), F.lit("master"))
    return own.select("seq", "at", "item_id", action.alias("action")).union(nobody)


@query(f"WITH {MOVES} SELECT seq, item_id, action, violation FROM v WHERE violation IS NOT NULL")
def learning_moves_refused(spark, sf_dir):
    return store.moved(items(spark, sf_dir), moves(spark, sf_dir))[1]


@query(f"WITH {MOVES} SELECT normalized_form FROM after WHERE item_type = 'word' AND status = 'mastered' GROUP BY 1")
def mastered_word_forms(spark, sf_dir):
    return store.mastered_forms(store.moved(items(spark, sf_dir), moves(spark, sf_dir))[0])


@query(f"""WITH {MOVES} SELECT count(*) FILTER (status = 'learning') AS learning_count, count(*) FILTER (status = 'mastered') AS mastered_count, least(100, count(*) FILTER (status = 'learning')) AS due_count, (SELECT count(DISTINCT conv_id) FROM conversations) AS brief_count FROM after""")
def learner_counts(spark, sf_dir):
    after = store.moved(items(spark, sf_dir), moves(spark, sf_dir))[0]
    briefs = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return store.counts(after, after.where("status = 'learning'").limit(100), briefs)


@query(f"""WITH {ENC}, f AS (SELECT item_id, CASE WHEN length(normalized_form) % 2 = 0 THEN upper(normalized_form) ELSE '' END AS form FROM items)
SELECT item_id, CASE WHEN form <> '' THEN form ELSE display_form END AS display_form, form <> '' AND form <> display_form AS changed FROM items JOIN f USING (item_id)""")
def display_form_refresh(spark, sf_dir):
    own = items(spark, sf_dir)
    forms = own.select("item_id", F.when(F.length("normalized_form") % 2 == 0, F.upper("normalized_form")).otherwise("").alias("form"))
    return store.refreshed(own, forms).select("item_id", "display_form", F.col("_changed").alias("changed"))


@query(f"""WITH {ENC}, w AS (SELECT DISTINCT 'word' AS item_type, 'Form ' || (vec_id % 900) AS display_form, 'm' || (vec_id % 900) AS meaning FROM embeddings),
d AS (SELECT *, {SID.format("'word' || chr(31) || lower(display_form) || chr(31) || left(sha256(meaning), 32)")} AS item_id FROM w)
SELECT d.display_form, d.item_id, CASE WHEN i.item_id IS NULL THEN 'new' ELSE 'learning' END AS status FROM d LEFT JOIN items i ON d.item_id = i.item_id""")
def learning_status_lookup(spark, sf_dir):
    n = (F.col("vec_id") % 900).cast("string")
    asked = table(spark, sf_dir, "embeddings").select(F.lit("word").alias("item_type"), F.concat(F.lit("Form "), n).alias("display_form"), F.concat(F.lit("m"), n).alias("meaning_zh"), F.lit("").alias("sense_key")).distinct()
    return store.status_of(asked, items(spark, sf_dir)).select("display_form", "item_id", "status")


DISC = """meta AS (SELECT event_id AS seq, 'u' || user_id AS identity, to_json({'candidate_id': 'u' || user_id, 'title': 'Title ' || (user_id % 70), 'doi': CASE WHEN user_id % 3 = 0 THEN 'https://doi.org/10.1/' || (user_id % 50) ELSE '' END, 'discovery_scope_id': 's' || (user_id % 2)})::VARCHAR AS metadata, event_id % 2 AS half, user_id FROM events),
old AS (SELECT identity, arg_max(metadata, seq) AS metadata, CASE WHEN max(user_id) % 4 = 0 THEN 'b1' END AS recommended_brief_id FROM meta WHERE half = 0 GROUP BY identity),
new AS (SELECT identity, arg_max(metadata, seq) AS metadata FROM meta WHERE half = 1 GROUP BY identity),
disc AS (SELECT coalesce(o.identity, n.identity) AS identity, CASE WHEN n.identity IS NOT NULL AND recommended_brief_id IS NULL THEN 2 ELSE 1 END AS day, CASE WHEN n.identity IS NOT NULL AND recommended_brief_id IS NULL THEN n.metadata ELSE o.metadata END AS metadata,
  recommended_brief_id, n.identity IS NOT NULL AND recommended_brief_id IS NULL AS changed FROM old o FULL JOIN new n ON o.identity = n.identity)"""


def discoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    s = lambda c: c.cast("string")
    own = F.concat(F.lit("u"), s(u))
    meta = F.to_json(F.struct(own.alias("candidate_id"), F.concat(F.lit("Title "), s(u % 70)).alias("title"), F.when(u % 3 == 0, F.concat(F.lit("https://doi.org/10.1/"), s(u % 50))).otherwise("").alias("doi"), F.concat(F.lit("s"), s(u % 2)).alias("discovery_scope_id")))
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), own.alias("identity"), meta.alias("metadata"), "user_id")
    day = lambda n: F.lit(f"2024-01-0{n}").cast("timestamp")
    none = spark.createDataFrame([], "identity string, discovered_at timestamp, metadata string, recommended_brief_id string")
    old = store.recorded(none, e.where("seq % 2 = 0"), day(1)).drop("_changed")
    items = e.where("seq % 2 = 0 and user_id % 4 = 0").select(F.col("identity").alias("item_id"), F.lit("b1").alias("brief_id")).distinct()
    return store.recorded(store.recommended(old, items), e.where("seq % 2 = 1"), day(2))


@query(f"WITH {DISC} SELECT identity, day, metadata, recommended_brief_id, changed FROM disc")
def discoveries_recorded(spark, sf_dir):
    return discoveries(spark, sf_dir).select("identity", F.dayofmonth("discovered_at").alias("day"), "metadata", "recommended_brief_id", F.col("_changed").alias("changed"))


@query(f"WITH {DISC} SELECT identity, day, metadata FROM disc WHERE recommended_brief_id IS NULL AND metadata::JSON->>'discovery_scope_id' = 's1'")
def unrecommended_pool(spark, sf_dir):
    return store.pool(discoveries(spark, sf_dir), "s1").select("identity", F.dayofmonth("first_discovered_at").alias("day"), "metadata")


@query(f"""WITH {DISC}, own AS (SELECT * FROM disc WHERE metadata::JSON->>'discovery_scope_id' = 's0')
SELECT DISTINCT key FROM (SELECT 'candidate:' || identity AS key FROM own UNION ALL SELECT 'title:' || trim(regexp_replace(lower(metadata::JSON->>'title'), '[^a-z0-9]+', ' ', 'g')) FROM own
UNION ALL SELECT 'doi:' || replace(metadata::JSON->>'doi', 'https://doi.org/', '') FROM own WHERE metadata::JSON->>'doi' <> '')""")
def seen_discovery_keys(spark, sf_dir):
    return store.seen_keys(discoveries(spark, sf_dir), "s0")


BRIEFS = """b AS (SELECT 'b' || (conv_id % 60) AS brief_id, max(conv_id) AS conv_id, string_agg(role || turn, ',' ORDER BY conv_id, turn, role) AS payload FROM conversations WHERE conv_id % 2 = 0 GROUP BY ALL),
f AS (SELECT 'b' || (conv_id % 90) AS brief_id, string_agg(role || turn, ',' ORDER BY conv_id, turn, role) AS payload FROM conversations WHERE conv_id % 3 = 0 GROUP BY ALL)"""


@query(f"""WITH {BRIEFS} SELECT coalesce(b.brief_id, f.brief_id) AS brief_id, coalesce(b.payload, f.payload) AS payload, CASE WHEN f.brief_id IS NULL THEN 'kept' WHEN b.brief_id IS NULL THEN 'new' WHEN b.payload = f.payload THEN 'same' ELSE 'clash' END AS outcome
FROM b FULL JOIN f ON b.brief_id = f.brief_id""")
def brief_import(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")

    def made(part: int, ids: int) -> DataFrame:
        own = c.where(F.col("conv_id") % part == 0).groupBy(F.concat(F.lit("b"), (F.col("conv_id") % ids).cast("string")).alias("brief_id"))
        turns = F.transform(F.array_sort(F.collect_list(F.struct("conv_id", "turn", "role"))), lambda x: F.concat(x["role"], x["turn"].cast("string")))
        return own.agg(F.lit(None).cast("timestamp").alias("created_at"), F.array_join(turns, ",").alias("payload"))

    return store.imported(made(2, 60), made(3, 90)).select("brief_id", "payload", "outcome")


@query("""WITH s AS (SELECT 'p' || (user_id % 80) AS paper_id, min(ts) AS tm FROM events WHERE event_type = 'signup' GROUP BY ALL), p AS (SELECT 'p' || p_partkey AS paper_id, CASE WHEN p_partkey % 9 = 0 THEN TIMESTAMP '2020-01-01' END AS t FROM part)
SELECT p.paper_id, epoch_us(coalesce(t, tm)) AS started FROM p LEFT JOIN s ON p.paper_id = s.paper_id""")
def preheat_starts(spark, sf_dir):
    key = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    papers = table(spark, sf_dir, "part").select(key.alias("paper_id"), F.when(F.col("p_partkey") % 9 == 0, F.lit("2020-01-01").cast("timestamp")).alias("preheat_started_at"))
    starts = table(spark, sf_dir, "events").where("event_type = 'signup'").select(F.concat(F.lit("p"), (F.col("user_id") % 80).cast("string")).alias("paper_id"), F.col("ts").cast("timestamp").alias("at"))
    return store.preheated(papers, starts).select("paper_id", F.unix_micros("preheat_started_at").alias("started"))


@query("""WITH r AS (SELECT 'd' || n_nationkey AS domain_id, '/w/' || n_nationkey AS workspace, n_name AS label FROM nation WHERE n_nationkey < 15),
e AS (SELECT 'd' || n_nationkey AS domain_id, '/w/' || CASE WHEN n_nationkey % 5 = 0 THEN n_nationkey + 1 ELSE n_nationkey END AS workspace, lower(n_name) AS label FROM nation WHERE n_nationkey >= 8),
j AS (SELECT e.*, CASE WHEN r.workspace <> e.workspace THEN 'id of another workspace' WHEN o.domain_id <> e.domain_id THEN 'workspace of another id' END AS violation FROM e LEFT JOIN r ON e.domain_id = r.domain_id LEFT JOIN r o ON e.workspace = o.workspace)
SELECT coalesce(r.domain_id, j.domain_id) AS domain_id, coalesce(r.workspace, j.workspace) AS workspace, coalesce(j.label, r.label) AS label, NULL::VARCHAR AS violation FROM r FULL JOIN (SELECT * FROM j WHERE violation IS NULL) j ON r.domain_id = j.domain_id
UNION ALL SELECT domain_id, workspace, label, violation FROM j WHERE violation IS NOT NULL""")
def domain_registry(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    old = n.where("n_nationkey < 15").select(F.concat(F.lit("d"), key.cast("string")).alias("domain_id"), F.concat(F.lit("/w/"), key.cast("string")).alias("workspace"), F.col("n_name").alias("label"))
    place = F.when(key % 5 == 0, key + 1).otherwise(key)
    new = n.where("n_nationkey >= 8").select(F.concat(F.lit("d"), key.cast("string")).alias("domain_id"), F.concat(F.lit("/w/"), place.cast("string")).alias("workspace"), F.lower("n_name").alias("label"))
    return store.registered(old, new)
