"""Incremental discovery: scans of several lanes, merged into the versions of what is known.

A row of a scan is an attempt of a lane or what it found: (seq, lane, kind, identity, at,
metadata). kind is `found`, `empty` (the lane answered, with nothing), `failed`, or
`recommended` (a brief has taken the identity; metadata is its id). seq orders all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.discovery import freshness
from quillspark.streaming.snapshots import Snapshots, made, put_json, run_increment

SCAN = "seq long, lane string, kind string, identity string, at timestamp, metadata string"
KNOWN = "identity string, first_at timestamp, discovered_at timestamp, metadata string, recommended_brief_id string"


def landing(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the scans that are put into a folder as Parquet files, which may still be empty."""
    made(spark, folder)
    return spark.readStream.schema(SCAN).parquet(folder)


def known(spark: SparkSession, root: str) -> Snapshots:
    return Snapshots(spark, f"{root}/known", KNOWN, "identity")


def folded(state: DataFrame, scan: DataFrame) -> DataFrame:
    """What is known after a scan, as if its rows came one by one.

    A found identity is put in, or takes the time and metadata of the finding while no brief
    has recommended it; the first recommendation of a known identity stays and closes it.
    Aggregates by identity, which tasks add up before they meet.
    """
    own = scan.where("kind in ('found', 'recommended') and trim(coalesce(identity, '')) <> ''").withColumn("identity", F.trim("identity"))
    found = F.col("kind") == "found"
    begun = own.groupBy("identity").agg(F.min(F.when(found, F.col("seq"))).alias("_first")).join(state.select("identity", F.lit(True).alias("_known"), "recommended_brief_id"), "identity", "left")
    begun = begun.where("recommended_brief_id is null").select("identity", F.when(F.col("_known"), F.lit(-(1 << 62))).otherwise(F.col("_first")).alias("_from"))
    live = own.join(begun, "identity").where("_from is not null")
    taken = live.where(~found & (F.col("seq") > F.col("_from"))).groupBy("identity").agg(F.min(F.struct("seq", "metadata")).alias("_brief"))
    last = live.join(taken, "identity", "left").where(found & (F.col("_brief").isNull() | (F.col("seq") < F.col("_brief.seq"))))
    last = last.groupBy("identity").agg(F.min("at").alias("_first_at"), F.max(F.struct("seq", "at", "metadata")).alias("_last"))
    change = last.join(taken, "identity", "full_outer").withColumnRenamed("identity", "_id")
    both = state.join(change, F.col("identity") == F.col("_id"), "full_outer")
    return both.select(
        F.coalesce("identity", "_id").alias("identity"),
        F.coalesce("first_at", "_first_at").alias("first_at"),
        F.coalesce("_last.at", "discovered_at").alias("discovered_at"),
        F.when(F.col("_last").isNotNull(), F.col("_last.metadata")).otherwise(F.col("metadata")).alias("metadata"),
        F.coalesce("recommended_brief_id", "_brief.metadata").alias("recommended_brief_id"),
    )


def discover(scans: DataFrame, root: str) -> None:
    """Merge what a stream of scans has now into the versions under root; a later call goes on from there.

    Each micro-batch is one increment. Its attempts by lane are written first
    (attempts-<epoch>.json); if no lane answered, nothing is committed and the state stays as
    it was. A micro-batch that is replayed is committed once.
    """
    spark, log = scans.sparkSession, f"{root}/log"
    store = known(spark, root)

    def put(rows: DataFrame, epoch: int) -> None:
        rows = rows.persist()
        try:
            ok = F.count_if(F.col("kind") != "failed")
            lanes = rows.groupBy("lane").agg(ok.alias("answered"), F.count_if(F.col("kind") == "failed").alias("failed"), F.count_if(F.col("kind") == "found").alias("found"))
            attempts = [r.asDict() for r in lanes.orderBy("lane").collect()]  # a row per lane
            put_json(spark, f"{root}/attempts-{epoch:010d}.json", attempts)
            if any(a["answered"] for a in attempts):
                store.merge(rows, folded, log, epoch, {"found": sum(a["found"] for a in attempts)})
        finally:
            rows.unpersist()

    run_increment(scans, put, log)


def pool(store: Snapshots, as_of, fresh_days: int = 14, recent_days: int = 1460, version: int | None = None) -> DataFrame:
    """All that no brief has recommended, with its freshness tier at `as_of`: what each scan shows again."""
    date = F.col("discovered_at").cast("date")
    return store.read(version).where("recommended_brief_id is null").withColumn("tier", freshness(date, as_of, fresh_days, recent_days))


def resumed(jobs: DataFrame, outcomes: DataFrame, key: str = "candidate_id") -> tuple[DataFrame, DataFrame]:
    """Jobs still to be done and outcomes that stand, after a run that was cut off.

    outcomes (key, valid, at): of repeated ones the last counts; a job whose last outcome is
    valid is not done again.
    """
    last = outcomes.groupBy(key).agg(F.max_by(F.struct(*[c for c in outcomes.columns if c != key]), "at").alias("_o")).select(key, "_o.*")
    stand = last.where("valid").join(jobs.select(key).distinct(), key, "left_semi")
    return jobs.join(stand.select(key), key, "left_anti"), stand
