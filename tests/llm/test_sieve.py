"""Wide rows that no pair names stay where they are."""

import random

from pyspark.sql import functions as F

from quillspark.llm import ngram_join, sieve
from quillspark.shared import written


def dealt_bytes(spark, made):
    """What a job writes for exchanges, with joins by shuffles, and its rows."""
    total = lambda: sum(x.totalShuffleWrite() for x in executors(spark))
    before, most = total(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = [tuple(r) for r in made().collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return total() - before, out


def executors(spark):
    found = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return [found.apply(i) for i in range(found.size())]


def test_texts_and_bins_of_no_pair_are_not_dealt_out(spark):
    rng = random.Random(4)
    texts = [(i, " ".join(f"{rng.getrandbits(40):x}" for _ in range(400))) for i in range(500)]
    texts.append((900, texts[7][1] + " more"))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    shingler, similarity = ngram_join.Shingler(5), ngram_join.Similarity()
    pairs = written(spark.createDataFrame([(7, 900), (8, 9)], "a long, b long"), "pairs")
    size, links = dealt_bytes(spark, lambda: ngram_join.verified(pairs, docs, shingler, similarity))
    assert links == [(7, 900)] and size < 0.1 * sum(len(t) for _, t in texts)
    sets = [(i, len(own := shingler(t)), ngram_join.binned(own)) for i, t in texts]
    classes = written(spark.createDataFrame(sets, "rep long, n long, bins binary"), "classes")
    size, kept = dealt_bytes(spark, lambda: ngram_join.likely(pairs, classes, similarity))
    assert (7, 900) in kept and size < 0.1 * sum(len(b) for *_, b in sets)


def test_sieve_loses_and_adds_no_row(spark):
    """Also where the map is full, for null keys and repeated rows."""
    before = sieve.BITS
    rows = spark.range(2000).select(F.when(F.col("id") > 9, F.col("id") % 1500).alias("k"), F.lit("x").alias("v"))
    ids = spark.range(0, 1500, 7).select(F.col("id").alias("k")).union(spark.createDataFrame([(99,), (5000,)], "k long"))
    want = {r.k for r in ids.collect()}
    every = sorted((r.k for r in rows.collect()), key=str)
    try:
        for bits in (before, sieve.ROW):
            sieve.BITS = bits
            rest = sieve.without(rows, "k", ids)
            assert rest.columns == rows.columns and sorted((r.k for r in rest.collect()), key=str) == [k for k in every if k not in want]
            some = [r.k for r in sieve.maybe(rows, "k", ids).collect()]
            assert [k for k in sorted(some, key=str) if k in want] == [k for k in every if k in want] and len(some) < 0.3 * len(every)
        assert sieve.maybe(rows, "k", ids.limit(0)).count() == 0 and sieve.without(rows, "k", ids.limit(0)).count() == 2000
    finally:
        sieve.BITS = before
