"""Counts of word runs, against brute force over every place."""

import random
import re
from collections import Counter

from quillspark.operators import lexicon


def brute(texts, low, high, stop):
    total, documents = Counter(), Counter()
    for text in texts:
        own = Counter()
        for line in (text or "").split("\n"):
            w = [x.lower() for x in re.findall(r"[A-Za-z][A-Za-z'-]*", line)]
            for k in range(low, high + 1):
                own.update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1) if w[i] not in stop and w[i + k - 1] not in stop)
        total.update(own)
        documents.update(own.keys())
    least = 2 if len(texts) >= 3 else 1
    return {t: (n, documents[t], len(t.split(" "))) for t, n in total.items() if n >= 2 and documents[t] >= least and len(t) >= 5}


def test_runs_against_brute_force(spark):
    """Runs across batches, lines and tasks; signs that only become letters in lower case are none (the SQL takes words first)."""
    rng = random.Random(4)
    words = ["a", "a'x", "a-", "the", "of", "Big", "bigger", "red", "x", "y"]
    texts = [" ".join(rng.choice([*words, "\n", "1"]) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    texts += [None, "", "the of the of", "\u212aelvin scale", "\u212aelvin scale and\r\nmore", "one line\n" * 50, "one line\n" * 50]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for low, high, stop, rows in ((2, 6, ("the", "of"), texts), (2, 3, (), texts), (3, 4, ("a",), texts), (2, 6, ("the",), texts[:2]), (2, 6, (), [])):
            docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)
            got = {r.term: (r.total_count, r.document_count, r.size) for r in lexicon.corpus_terms(docs, low, high, stop).collect()}
            assert got == brute(rows, low, high, stop)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert "kelvin scale" not in {r.term for r in lexicon.corpus_terms(spark.createDataFrame([(i, "\u212aelvin scale") for i in range(3)], "doc_id long, text string")).collect()}
