"""Calibration sessions as state machines over a stream of their events.

An event is (session_id, seq, kind, snapshot, revision, lemma, response, percent). Each
session keeps its answers, the hash of the vocabulary they were given on, a revision that
every change raises, and the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Questions of a session, what can be answered, and the thresholds that can be set, in percent.
QUESTIONS, RESPONSES = 30, ("known", "unknown", "unsure")
THRESHOLD, LOWEST, HIGHEST = 90, 75, 98

EVENT = "session_id string, seq long, kind string, snapshot string, revision long, lemma string, response string, percent long"
OUT = "session_id string, seq long, outcome string, revision long, answered long, known long, unknown long, unsure long, percent long, complete boolean"
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def snapshot_hash(words: DataFrame) -> DataFrame:
    """One row: a hash of 256 bits of the rows of a vocabulary, whatever their order (snapshot): the sum of the rows' hashes in eight lanes, with their number.

    A null and an empty text differ. Sums are partial aggregates.
    """
    fields = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in sorted(words.columns)]
    own = words.select(F.sha2(F.concat_ws("\x1f", *fields), 256).alias("h"))
    lane = lambda k: F.sum(F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("long")) % (1 << 32)
    lanes = [F.lpad(F.lower(F.hex(F.coalesce(lane(k), F.lit(0)))), 8, "0") for k in range(8)]
    return own.agg(F.concat(F.count(F.lit(1)).cast("string"), F.lit(":"), *lanes).alias("snapshot"))


class Session:
    """What one session has; a pure fold over its events."""

    def __init__(self, snapshot: str | None = None, revision: int = 0, percent: int = THRESHOLD, answers: list[tuple[str, str]] | None = None):
        self.snapshot, self.revision, self.percent, self.answers = snapshot, revision, percent, list(answers or ())

    def take(self, kind: str, snapshot: str, revision: int | None, lemma: str | None, response: str | None, percent: int | None) -> str:
        """The outcome of an event.

        Another snapshot: the session begins anew, and then takes the event. A revision that
        is not the present one: refused. An answer needs a known response to a word not
        answered yet, of fewer than all questions; a threshold is of the range; a reset takes
        all answers back. What is taken raises the revision.
        """
        fresh = self.snapshot is not None and snapshot != self.snapshot
        if fresh or self.snapshot is None:
            self.__init__(snapshot)
        outcome = self._judged(kind, revision, lemma, response, percent)
        if outcome != "taken":
            return f"begun anew, {outcome}" if fresh else outcome
        if kind == "answer":
            self.answers.append((lemma, response))
        elif kind == "threshold":
            self.percent = percent
        else:
            self.answers = []
        self.revision += 1
        return "begun anew" if fresh else "taken"

    def _judged(self, kind, revision, lemma, response, percent) -> str:
        if revision is not None and revision != self.revision:
            return "stale"
        if kind == "answer":
            if response not in RESPONSES or not lemma:
                return "invalid"
            if len(self.answers) >= QUESTIONS:
                return "complete"
            return "repeated" if lemma in {a for a, _ in self.answers} else "taken"
        if kind == "threshold":
            return "taken" if percent is not None and LOWEST <= percent <= HIGHEST else "invalid"
        return "taken" if kind == "reset" else "invalid"

    def counts(self) -> list[int]:
        said = [r for _, r in self.answers]
        return [said.count(r) for r in RESPONSES]


class _Sessions(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.meta = handle.getValueState("meta", "snapshot string, revision long, percent long")
        self.answers = handle.getListState("answers", "lemma string, response string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        session = Session()
        if self.meta.exists():
            session = Session(*self.meta.get(), [tuple(a) for a in self.answers.get()])
        names = ["seq", "kind", "snapshot", "revision", "lemma", "response", "percent"]
        events = sorted((tuple(None if pd.isna(v) else v for v in r) for df in rows for r in df[names].itertuples(index=False)), key=lambda e: e[0])  # of one session and micro-batch
        out = []
        for seq, kind, snapshot, revision, lemma, response, percent in events:
            outcome = session.take(kind, snapshot, revision, lemma, response, None if percent is None else int(percent))
            out.append((key[0], seq, outcome, session.revision, len(session.answers), *session.counts(), session.percent, len(session.answers) == QUESTIONS))
        self.meta.update((session.snapshot, int(session.revision), int(session.percent)))
        self.answers.clear()
        if session.answers:
            self.answers.put(session.answers)
        yield pd.DataFrame(out, columns=[f.split(" ")[0] for f in OUT.split(", ")])

    def close(self) -> None:
        pass


def sessions(events: DataFrame) -> DataFrame:
    """The outcome of each event of a stream of EVENT, and what its session then has.

    Events of a micro-batch are taken by seq; one that comes in a later micro-batch is taken
    where it comes. State is kept in RocksDB, which the session must name as its state store
    (state_store()).
    """
    return events.groupBy("session_id").transformWithStateInPandas(statefulProcessor=_Sessions(), outputStructType=OUT, outputMode="Update", timeMode="None")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that begin inside keep their state in RocksDB."""
    name, value = ROCKS
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def loadable(results: DataFrame) -> DataFrame:
    """Whether completed sessions can be loaded: rows (session_id, answers, counts, threshold, importance) to session_id, violation (null: they can)."""
    bad = F.exists("answers", lambda a: a["lemma"].isNull() | ~F.coalesce(a["response"].isin(*RESPONSES), F.lit(False)))
    missing: Column = F.col("counts").isNull() | F.col("threshold").isNull() | F.col("importance").isNull()
    why = F.when(F.col("answers").isNull() | (F.size("answers") != QUESTIONS), "answers incomplete").when(bad, "no such answer")
    why = why.when(F.size(F.array_distinct(F.transform("answers", lambda a: a["lemma"]))) != QUESTIONS, "a word answered twice").when(missing, "result incomplete")
    return results.select("session_id", why.alias("violation"))
