"""Queries over increments and sessions kept by streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.plans.base import query, table
from quillspark.shared import new_path
from quillspark.streaming import increments, reviews, sessions

#: Deliveries of the table's events, oldest first.
DELIVERIES = 4


def scans(events: DataFrame) -> DataFrame:
    """Events as scans: purchases recommend a user's day, errors are failed attempts, all others find one."""
    kind = F.when(F.col("event_type") == "purchase", "recommended").when(F.col("event_type") == "error", "failed").otherwise("found")
    metadata = F.when(F.col("event_type") == "purchase", F.col("event_id").cast("string")).otherwise(F.col("props"))
    return events.select(F.col("event_id").alias("seq"), F.col("event_type").alias("lane"), kind.alias("kind"), F.concat_ws("@", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("identity"), F.col("ts").cast("timestamp").alias("at"), metadata.alias("metadata"))


#: All at once what increments fold one by one: a user's day is closed by its first purchase after a find.
FOLD = """e AS (SELECT *, user_id || '@' || strftime(ts, '%Y-%m-%d') AS identity FROM events), c AS (SELECT * FROM e WHERE event_type IN ('view', 'click', 'signup')),
f AS (SELECT identity, min(event_id) AS f FROM c GROUP BY identity), b AS (SELECT identity, min(event_id) AS brief FROM e JOIN f USING (identity) WHERE event_type = 'purchase' AND event_id > f GROUP BY identity)"""


def delivered(spark: SparkSession, sf_dir: str) -> str:
    """The folder of versions after all events came in deliveries, each taken by the stream where it had stopped."""
    rows, root = scans(table(spark, sf_dir, "events")), new_path(spark, "discovery")
    cuts = rows.agg(F.percentile_approx("seq", [k / DELIVERIES for k in range(1, DELIVERIES)])).first()[0] or []
    bounds = [None, *sorted(set(cuts)), None]
    stream = increments.landing(spark, f"{root}/landing")
    for low, high in zip(bounds, bounds[1:], strict=False):
        some = (F.lit(True) if low is None else F.col("seq") > low) & (F.lit(True) if high is None else F.col("seq") <= high)
        rows.where(some).write.mode("append").parquet(f"{root}/landing")
        increments.discover(stream, root)
    return root


@query(f"""WITH {FOLD} SELECT identity, epoch_us(min(ts)) AS first_us, epoch_us(arg_max(ts, event_id)) AS discovered_us, arg_max(props, event_id) AS metadata, max(brief)::VARCHAR AS recommended_brief_id
FROM c LEFT JOIN b USING (identity) WHERE brief IS NULL OR event_id < brief GROUP BY identity""")
def incremental_discovery(spark, sf_dir):
    """What is known after events came in several deliveries, each merged into a committed version."""
    store = increments.known(spark, delivered(spark, sf_dir))
    micros = lambda c: F.unix_micros(F.col(c))
    return store.read().select("identity", micros("first_at").alias("first_us"), micros("discovered_at").alias("discovered_us"), "metadata", "recommended_brief_id")


@query(f"""WITH {FOLD}, l AS (SELECT identity, arg_max(ts, event_id)::DATE AS d FROM c WHERE identity NOT IN (SELECT identity FROM b) GROUP BY identity), n AS (SELECT max(ts)::DATE AS now FROM events)
SELECT identity, CASE WHEN d >= now - 2 THEN 'new' WHEN d >= now - 7 THEN 'recent' ELSE 'classic' END AS tier FROM l, n""")
def discovery_pool(spark, sf_dir):
    """The pool that is shown again after the last scan: what no brief has taken, of three weeks of freshness tiers."""
    store = increments.known(spark, delivered(spark, sf_dir))
    now = table(spark, sf_dir, "events").agg(F.max("ts").cast("date")).first()[0]
    return increments.pool(store, F.lit(now), fresh_days=2, recent_days=7).select("identity", "tier")


def session_events(events: DataFrame) -> DataFrame:
    """Events as those of users' sessions: answers on words by props, thresholds by value, resets; weeks have their own vocabulary."""
    t, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("long")
    return events.select(
        F.col("user_id").cast("string").alias("session_id"),
        F.col("event_id").alias("seq"),
        F.when(t == "purchase", "threshold").when((t == "error") & (F.col("value") >= 40), "reset").otherwise("answer").alias("kind"),
        F.date_trunc("week", "ts").cast("date").cast("string").alias("snapshot"),
        F.when(F.col("value") < 8, k % 4).alias("revision"),
        F.concat(F.lit("w"), k).alias("lemma"),
        F.when(t == "view", "known").when(t == "click", "unknown").when(t == "signup", "unsure").alias("response"),
        F.floor(F.col("value") * 3).alias("percent"),
    )


#: One event of each session a round, with what the session has as a row.
SESSIONS = """e AS (SELECT user_id::VARCHAR AS session_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r,
  CASE WHEN event_type = 'purchase' THEN 'threshold' WHEN event_type = 'error' AND value >= 40 THEN 'reset' ELSE 'answer' END AS kind, date_trunc('week', ts)::DATE::VARCHAR AS snapshot,
  CASE WHEN value < 8 THEN (props::JSON->>'k')::BIGINT % 4 END AS expected, 'w' || (props::JSON->>'k') AS lemma,
  CASE event_type WHEN 'view' THEN 'known' WHEN 'click' THEN 'unknown' WHEN 'signup' THEN 'unsure' END AS response, floor(value * 3)::BIGINT AS percent FROM events),
s AS (SELECT session_id, 0::BIGINT AS r, NULL::BIGINT AS seq, NULL::VARCHAR AS outcome, NULL::VARCHAR AS snap, 0::BIGINT AS revision, 90::BIGINT AS pct, []::STRUCT(l VARCHAR, a VARCHAR)[] AS answers FROM e GROUP BY session_id
  UNION ALL
  SELECT session_id, r, seq, CASE WHEN fresh AND judged = 'taken' THEN 'begun anew' WHEN fresh THEN 'begun anew, ' || judged ELSE judged END, snapshot, CASE WHEN judged = 'taken' THEN rev + 1 ELSE rev END,
    CASE WHEN judged = 'taken' AND kind = 'threshold' THEN percent ELSE p END,
    CASE WHEN judged = 'taken' AND kind = 'answer' THEN list_append(held, {l: lemma, a: response}) WHEN judged = 'taken' AND kind = 'reset' THEN [] ELSE held END
  FROM (SELECT *, CASE WHEN expected IS NOT NULL AND expected <> rev THEN 'stale' WHEN kind = 'answer' THEN CASE WHEN response IS NULL THEN 'invalid' WHEN len(held) >= 30 THEN 'complete'
      WHEN len(list_filter(held, lambda x: x.l = lemma)) > 0 THEN 'repeated' ELSE 'taken' END WHEN kind = 'threshold' THEN CASE WHEN percent BETWEEN 75 AND 98 THEN 'taken' ELSE 'invalid' END ELSE 'taken' END AS judged
    FROM (SELECT e.*, s.snap IS NOT NULL AND s.snap <> e.snapshot AS fresh, CASE WHEN s.snap = e.snapshot THEN s.revision ELSE 0 END AS rev, CASE WHEN s.snap = e.snapshot THEN s.pct ELSE 90 END AS p,
      CASE WHEN s.snap = e.snapshot THEN s.answers ELSE [] END AS held FROM s JOIN e ON e.session_id = s.session_id AND e.r = s.r + 1)))"""


@query(f"""WITH RECURSIVE {SESSIONS} SELECT session_id, seq, outcome, revision, len(answers)::BIGINT AS answered, len(list_filter(answers, lambda x: x.a = 'known'))::BIGINT AS known,
len(list_filter(answers, lambda x: x.a = 'unknown'))::BIGINT AS unknown, len(list_filter(answers, lambda x: x.a = 'unsure'))::BIGINT AS unsure, pct AS percent, len(answers) = 30 AS complete FROM s WHERE r > 0""")
def calibration_sessions(spark, sf_dir):
    """The outcome of every event of every user's calibration session, kept by a stream."""
    events = session_events(reviews.event_stream(spark, sf_dir))
    with sessions.state_store(spark):
        return reviews.drained(sessions.sessions(events), "sessions", "update").drop("epoch")


SNAPSHOT = " || ".join(f"lpad(lower(hex(coalesce(sum(('0x' || substr(h, {8 * k + 1}, 8))::BIGINT) % 4294967296, 0)::BIGINT)), 8, '0')" for k in range(8))


@query(f"SELECT count(*)::VARCHAR || ':' || {SNAPSHOT} AS snapshot FROM (SELECT sha256(coalesce('=' || doc_id, '-') || chr(31) || coalesce('=' || lang, '-') || chr(31) || coalesce('=' || text, '-')) AS h FROM documents)")
def snapshot_hash(spark, sf_dir):
    """The order-free hash of all documents."""
    return sessions.snapshot_hash(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
