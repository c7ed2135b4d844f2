"""Spaced-review state and discovery as streams over files of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspark.operators.scheduling import Card, Scheduler
from quillspark.shared import new_path

OUT = "item_id long, reviews long, lapses long, state int, step int, stability double, difficulty double, last_review timestamp, due timestamp"
STATE = "reviews long, lapses long, state int, step int, stability double, difficulty double, last long, due long"


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    scheduler, card, n, lapses = Scheduler(), Card(), 0, 0
    if state.exists:
        n, lapses, kind, step, s, d, last, due = state.get
        card = Card(kind, None if step < 0 else step, s, d, pd.Timestamp(last, unit="us"), pd.Timestamp(due, unit="us"))
    for r in pd.concat(list(frames)).sort_values(["at", "seq"]).itertuples():
        card, n, lapses = scheduler.review(card, r.rating, r.at), n + 1, lapses + (r.rating == "again")
    step = -1 if card.step is None else card.step
    state.update((n, lapses, card.state, step, card.stability, card.difficulty, int(card.last.value // 1000), int(card.due.value // 1000)))
    yield pd.DataFrame({"item_id": [key[0]], "reviews": [n], "lapses": [lapses], "state": [card.state], "step": [step], "stability": [card.stability], "difficulty": [card.difficulty], "last_review": [card.last], "due": [card.due]})


def review_states(log: DataFrame) -> DataFrame:
    """The state of each item after each micro-batch of a stream of reviews (item_id, seq, rating, at).

    Reviews of a micro-batch are taken in the order of time and seq; one that comes in a
    later micro-batch than its time says is taken where it comes, as of zero days later.
    step is -1 in review.
    """
    return log.groupBy("item_id").applyInPandasWithState(_fold, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def review_log(log: DataFrame) -> DataFrame:
    """The rows that a review appends to the log, as a stream."""
    return log.select("item_id", "rating", F.col("at").alias("reviewed_at"), F.to_json(F.struct("item_id", "rating", "at")).alias("log_json"))


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def drained(stream: DataFrame, tag: str, mode: str) -> DataFrame:
    """All that a stream gives for the files there are now, as a table: a folder for each micro-batch, written over on replay."""
    spark = stream.sparkSession
    out = new_path(spark, tag)

    def put(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}-log").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return spark.read.parquet(out)


def latest(states: DataFrame) -> DataFrame:
    """The last state of each item over drained micro-batches."""
    rest = [c for c in states.columns if c not in ("item_id", "epoch")]
    by = states.groupBy("item_id").agg(F.max_by(F.struct(*rest), "epoch").alias("s"))
    return by.select("item_id", "s.*")


def first_discoveries(stream: DataFrame, key: str, at: str, lateness: str = "3650 days") -> DataFrame:
    """A stream of candidates without those whose key came before, as far back as the watermark keeps."""
    return stream.withWatermark(at, lateness).dropDuplicatesWithinWatermark([key])
