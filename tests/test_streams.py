"""Versions of a table, incremental discovery that is killed and resumed, sessions kept by streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillspark.streaming import increments, sessions, snapshots
from quillspark.streaming.snapshots import Snapshots

T0 = dt.datetime(2024, 1, 1)
TALLY = "k string, n long"


def added(state, rows):
    return state.unionByName(rows.select("k", F.col("n").cast("long"))).groupBy("k").agg(F.sum("n").alias("n"))


def scan(spark, *rows):
    """(seq, lane, kind, identity, metadata); a row's time is its seq in minutes."""
    return spark.createDataFrame([(s, lane, kind, i, T0 + dt.timedelta(minutes=s), m) for s, lane, kind, i, m in rows], increments.SCAN)


def state(spark, root):
    return {r.identity: (r.discovered_at, r.metadata, r.recommended_brief_id) for r in increments.known(spark, root).read().collect()}


def at(n):
    return T0 + dt.timedelta(minutes=n)


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/store"


def test_json_is_whole_or_not_there(spark, root):
    path = f"{root}/a.json"
    snapshots.put_json(spark, path, {"ö": [1, None]})
    snapshots.put_json(spark, path, {"b": 2})
    assert snapshots.get_json(spark, path) == {"b": 2}
    with pytest.raises(Exception, match="exist"):
        snapshots.put_json(spark, path, {"c": 3}, replace=False)
    assert snapshots.get_json(spark, path) == {"b": 2} and snapshots.names(spark, root) == ["a.json"]


def test_versions(spark, root):
    store = Snapshots(spark, root, TALLY, "k", buckets=4)
    assert store.read().count() == 0 and store.manifest() is None
    assert store.merge(spark.createDataFrame([("a", 1), ("b", 2)], TALLY), added, "s", 0)
    assert store.merge(spark.createDataFrame([("a", 5)], TALLY), added, "s", 1)
    assert not store.merge(spark.createDataFrame([("a", 5)], TALLY), added, "s", 1)  # replayed
    assert store.merge(spark.createDataFrame([("c", 7)], TALLY), added, "other", 0)  # another stream has its own epochs
    assert sorted(map(tuple, store.read().collect())) == [("a", 6), ("b", 2), ("c", 7)]
    assert sorted(map(tuple, store.read(0).collect())) == [("a", 1), ("b", 2)]
    first, second = store.manifest(0)["buckets"], store.manifest(1)["buckets"]
    assert sum(first[b] == second[b] for b in first) == len(first) - 1  # the other buckets' files are not written again
    store.swept(keep=1)
    assert sorted(map(tuple, store.read().collect())) == [("a", 6), ("b", 2), ("c", 7)] and store.manifest(0) is None
    assert len(snapshots.names(spark, f"{root}/versions")) == 1


def test_two_writers_do_not_both_commit(spark, root):
    a, b = (Snapshots(spark, root, TALLY, "k") for _ in range(2))
    rows = spark.createDataFrame([("a", 1)], TALLY)

    def meanwhile(held, new):
        assert b.merge(rows, added, "b", 0)
        return added(held, new)

    with pytest.raises(Exception, match="exist"):
        a.merge(rows, meanwhile, "a", 0)
    assert [tuple(r) for r in a.read().collect()] == [("a", 1)] and a.manifest()["epochs"] == {"b": 0}


def test_guarded_fold(spark):
    known = spark.createDataFrame([("old", at(0), at(0), "m0", None), ("taken", at(0), at(0), "m0", "b0")], increments.KNOWN)
    rows = scan(
        spark, (1, "a", "recommended", "new", "b1"), (2, "a", "found", " new ", "m2"), (3, "b", "found", "new", "m3"), (4, "a", "recommended", "new", "b4"), (5, "a", "found", "new", "m5"), (6, "a", "recommended", "new", "b6"),
        (7, "a", "found", "taken", "m7"), (8, "a", "recommended", "old", "b8"), (9, "a", "found", "old", "m9"), (10, "a", "found", " ", "m"), (11, "a", "found", None, "m"), (12, "c", "failed", None, None), (13, "a", "recommended", "never", "b13"), (14, "a", "found", "fresh", None),
    )
    got = {r.identity: (r.first_at, r.discovered_at, r.metadata, r.recommended_brief_id) for r in increments.folded(known, rows).collect()}
    assert got == {"new": (at(2), at(3), "m3", "b4"), "taken": (at(0), at(0), "m0", "b0"), "old": (at(0), at(0), "m0", "b8"), "fresh": (at(14), at(14), None, None)}
    assert increments.folded(known.where("false"), rows.where("false")).count() == 0


def test_killed_and_resumed(spark, root, monkeypatch):
    """A crash before the commit does the increment again; one after it does not do it twice."""
    stream = increments.landing(spark, f"{root}/landing")

    def deliver(*rows):
        scan(spark, *rows).coalesce(1).write.mode("append").parquet(f"{root}/landing")

    deliver((1, "a", "found", "x", "m1"), (2, "a", "found", "y", "m2"))
    increments.discover(stream, root)
    assert state(spark, root) == {"x": (at(1), "m1", None), "y": (at(2), "m2", None)}

    deliver((3, "a", "found", "x", "m3"), (4, "b", "found", "z", "m4"), (5, "b", "recommended", "y", "b5"))
    put = snapshots.put_json

    def dies_before(spark, path, value, replace=True):
        if "/versions/" in path:
            raise OSError("killed")
        put(spark, path, value, replace)

    monkeypatch.setattr(snapshots, "put_json", dies_before)
    with pytest.raises(Exception):
        increments.discover(stream, root)
    assert state(spark, root) == {"x": (at(1), "m1", None), "y": (at(2), "m2", None)}

    def dies_after(spark, path, value, replace=True):
        put(spark, path, value, replace)
        if "/versions/" in path:
            raise OSError("killed")

    monkeypatch.setattr(snapshots, "put_json", dies_after)
    with pytest.raises(Exception):
        increments.discover(stream, root)
    want = {"x": (at(3), "m3", None), "y": (at(2), "m2", "b5"), "z": (at(4), "m4", None)}
    assert state(spark, root) == want and increments.known(spark, root).manifest()["version"] == 1

    monkeypatch.setattr(snapshots, "put_json", put)
    increments.discover(stream, root)  # the same micro-batch again
    assert state(spark, root) == want and increments.known(spark, root).manifest()["version"] == 1
    store = increments.known(spark, root)
    assert {r.identity: r.tier for r in increments.pool(store, F.lit(dt.date(2024, 1, 20))).collect()} == {"x": "recent", "z": "recent"}


def test_all_lanes_failed(spark, root):
    stream = increments.landing(spark, f"{root}/landing")
    scan(spark, (1, "a", "found", "x", "m1"), (2, "b", "failed", None, None)).coalesce(1).write.mode("append").parquet(f"{root}/landing")
    increments.discover(stream, root)
    before = increments.known(spark, root).manifest()
    scan(spark, (3, "a", "failed", None, None), (4, "b", "failed", "x", "m4")).coalesce(1).write.mode("append").parquet(f"{root}/landing")
    increments.discover(stream, root)
    assert increments.known(spark, root).manifest() == before
    assert snapshots.get_json(spark, f"{root}/attempts-0000000001.json") == [{"lane": "a", "answered": 0, "failed": 1, "found": 0}, {"lane": "b", "answered": 0, "failed": 1, "found": 0}]
    scan(spark, (5, "a", "found", "y", "m5"), (6, "b", "empty", None, None)).coalesce(1).write.mode("append").parquet(f"{root}/landing")
    increments.discover(stream, root)
    assert set(state(spark, root)) == {"x", "y"} and increments.known(spark, root).manifest()["version"] == 1


def test_resumed_jobs(spark):
    jobs = spark.createDataFrame([("a",), ("b",), ("c",)], "candidate_id string")
    outcomes = spark.createDataFrame([("a", True, 1), ("b", True, 1), ("b", False, 2), ("gone", True, 1)], "candidate_id string, valid boolean, at long")
    left, stand = increments.resumed(jobs, outcomes)
    assert sorted(r[0] for r in left.collect()) == ["b", "c"] and [tuple(r) for r in stand.collect()] == [("a", True, 1)]


# ---- calibration sessions


def event(seq, kind="answer", snapshot="v1", revision=None, lemma=None, response="known", percent=None, session="s"):
    return (session, seq, kind, snapshot, revision, lemma, response if kind == "answer" else None, percent)


def outcomes(spark, tmp_path, *batches):
    """Outcomes by session and seq of events that come in several micro-batches, the stream stopped between two."""
    folder = f"{tmp_path}/events"
    got = []
    for rows in batches:
        spark.createDataFrame(list(rows), sessions.EVENT).coalesce(1).write.mode("append").parquet(folder)
        stream = sessions.sessions(spark.readStream.schema(sessions.EVENT).parquet(folder))
        out = stream.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True)
        with sessions.state_store(spark):
            out.foreachBatch(lambda df, _: got.extend(df.collect())).start().awaitTermination()
    return {(r.session_id, r.seq): r for r in got}


def test_session(spark, tmp_path):
    first = [event(1, lemma="a", revision=0), event(2, lemma="a"), event(3, lemma="b", revision=0), event(4, lemma="b", response="unsure", revision=1), event(5, lemma="c", response="maybe"), event(6, "threshold", percent=60), event(7, "threshold", percent=80), event(8, "shrug"), event(1, lemma="z", session="t")]
    second = [event(10, lemma="c", response="unknown", revision=2), event(11, lemma="c", response="unknown", revision=3), event(12, lemma="d", snapshot="v2"), event(13, lemma="a", snapshot="v2", revision=9), event(14, "reset", snapshot="v2", revision=1)]
    got = outcomes(spark, tmp_path, first, second)
    said = [got["s", n].outcome for n in (1, 2, 3, 4, 5, 6, 7, 8, 10, 11, 12, 13, 14)]
    assert said == ["taken", "repeated", "stale", "taken", "invalid", "invalid", "taken", "invalid", "stale", "taken", "begun anew", "stale", "taken"]
    assert tuple(got["s", 11])[3:] == (4, 3, 1, 1, 1, 80, False) and tuple(got["s", 12])[3:] == (1, 1, 1, 0, 0, 90, False) and tuple(got["s", 14])[3:] == (2, 0, 0, 0, 0, 90, False)
    assert got["t", 1].answered == 1


def test_whole_session(spark, tmp_path):
    rows = [event(n, lemma=f"w{n}", response=sessions.RESPONSES[n % 3], revision=n) for n in range(31)]
    got = outcomes(spark, tmp_path, rows[:11], rows[11:])
    assert got["s", 29].complete and not got["s", 28].complete and got["s", 30].outcome == "complete" and got["s", 30].revision == 30
    assert (got["s", 29].known, got["s", 29].unknown, got["s", 29].unsure) == (10, 10, 10)


def test_loadable(spark):
    good = [(f"w{i}", "known") for i in range(30)]
    rows = [("good", good, 1, 1, 1), ("short", good[1:], 1, 1, 1), ("none", None, 1, 1, 1), ("odd", good[1:] + [("x", "?")], 1, 1, 1), ("twice", good[1:] + [good[1]], 1, 1, 1), ("bare", good, 1, None, 1)]
    df = spark.createDataFrame(rows, "session_id string, answers array<struct<lemma:string,response:string>>, counts int, threshold int, importance int")
    assert {r.session_id: r.violation for r in sessions.loadable(df).collect()} == {"good": None, "short": "answers incomplete", "none": "answers incomplete", "odd": "no such answer", "twice": "a word answered twice", "bare": "result incomplete"}


def test_snapshot_hash(spark):
    h = lambda *rows: sessions.snapshot_hash(spark.createDataFrame(list(rows), "lemma string, n int")).first()[0]
    assert h(("a", 1), ("b", 2)) == h(("b", 2), ("a", 1)) != h(("a", 1)) != h(("a", 1), ("a", 1))
    assert h((None, 1)) != h(("", 1)) and h() == "0:" + "0" * 64
