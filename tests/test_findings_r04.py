"""Findings of the fourth round."""

import math
import random

import pyarrow as pa
from pyspark.sql import functions as F

from quillspark.operators import contexts, learning, lexicon, packets
from tests.test_dealt import dealt


def names_of(plan):
    open_nodes, out = [plan.initialPlan() if "Adaptive" in plan.nodeName() else plan], []
    while open_nodes:
        node = open_nodes.pop()
        out.append(node.nodeName())
        open_nodes += [node.children().apply(i) for i in range(node.children().size())]
    return out


def test_fuzzy_counts_make_no_row_a_query_and_name(spark):
    """Counts are added up where names are read: nothing is exploded by query after the words have met."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 10)))
    names = spark.createDataFrame([(" ".join(word() for _ in range(rng.randint(1, 5))),) for _ in range(200)] + [(None,), ("",)], "name string")
    queries = spark.createDataFrame([(x,) for x in sorted({word() for _ in range(60)})], "query string")
    got = learning.fuzzy_counts(names.union(names), queries)
    want = learning.fuzzy_search(names, queries).groupBy("query").agg(F.count(F.lit(1)).alias("matches"), F.min("name").alias("first_name"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect())
    assert "Generate" not in names_of(got._jdf.queryExecution().executedPlan())


def test_terms_are_dealt_out_in_packets(spark):
    """Windows, terms and their parts are compressed by bucket before they are dealt out; a part that stands in no other term has its own count."""
    docs = spark.createDataFrame([(1, "deep neural nets learn\nred fox"), (2, "deep neural nets learn\nred fox"), (3, "deep neural nets"), (4, None)], "doc_id long, text string")
    got = lexicon.c_values(lexicon.corpus_terms(docs))
    assert {columns for columns in map(tuple, dealt(got))} <= {("bucket", "packet"), ("count",), ("documents",)}
    want = {"deep neural": (3, 0.5), "neural nets": (3, 0.666667), "deep neural nets": (3, round(math.log2(3), 6)), "red fox": (2, 2.0), "nets learn": (2, 0.0), "neural nets learn": (2, 0.0), "deep neural nets learn": (2, 4.0)}
    assert {r.term: (r.total_count, r.c_value) for r in got.collect()} == want


def test_packets_give_all_rows_by_key(spark):
    def made(batches):
        for batch in batches:
            yield pa.record_batch([batch.column(0).cast(pa.string()), batch.column(0)], names=["k", "n"])

    rows = spark.range(0, 5000, 1, 3).select((F.col("id") % 700).alias("n"))
    got = packets.dealt(rows, made, lambda b: b.column(0), "k string, n long").withColumn("part", F.spark_partition_id())
    by = got.groupBy("k").agg(F.count(F.lit(1)).alias("c"), F.count_distinct("part").alias("parts"), F.min("n").alias("n")).collect()
    assert len(by) == 700 and sum(r.c for r in by) == 5000 and all(r.parts == 1 and r.k == str(r.n) for r in by)


def test_contexts_deal_out_texts_alone(spark):
    """Neither runs of words nor forms nor contexts are dealt out; a document in several rows has its longest context once."""
    docs = spark.createDataFrame([(1, "Deep nets learn. A Deep-Net!"), (1, "We like deep  nets now."), (2, "Deep, nets. No end deep nets"), (None, "deep nets."), (3, None)], "doc_id long, text string")
    forms = spark.createDataFrame([("dn", "deep nets", 1), ("dn", "deep-net", 0), ("deep nets", "deep nets", 0), ("deep nets", "deep nets", 0)], "term string, form string, rank int")
    got = contexts.term_contexts(docs, forms)
    assert dealt(got) == [["doc_id", "text"]]
    assert sorted(tuple(r) for r in got.collect()) == [(1, "deep nets", "We like deep nets now."), (1, "dn", "We like deep nets now.")]
