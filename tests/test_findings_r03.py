"""Steps that findings of round 3 were about."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import toxicity
from quillspark.llm.common import LETTERS
from quillspark.operators import annotation, chunking, merging
from tests.llm.data import words

ODD = [
    (1, "The Tests of cities and ponies aren't lies. Boss buses gas IS Ωmega KKelvin 3rd-rate x's ı İs dis--cs!\nA second line: Red-hot news; ies ties"),
    (2, None),
    (3, ""),
    (4, "word.\n\n  Glass   Cars. cars   Éclairs of red cars; 12 'quoted' rock'n'roll's end_s\r\nlast. Alloys"),
    (4, "running quickly makeable news"),
]


def test_words_one_by_one_are_those_of_annotated_sentences(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    sents = chunking.annotated(docs).withColumn("mark", chunking.mark(F.col("sentence")))
    want = chunking.content(sents, "mark").collect()
    got = chunking.rule_words(docs, marked=True).collect()
    assert len(want) > 20 and sorted(map(str, got)) == sorted(map(str, want))


def test_a_phrase_is_made_a_term_once(spark):
    plan = chunking.phrases(chunking.annotated(spark.createDataFrame(ODD, "doc_id long, text string")))
    said = plan._jdf.queryExecution().optimizedPlan().toString()
    assert said.count("array_join(lambda") == 1 and "array_join(transform(slice" not in said  # of terms, at one place of the plan
    one = spark.range(1).select(annotation.known(F.lit(None).cast("string")))
    assert one.count() == 0


def test_merged_candidates_meet_without_the_driver(spark, monkeypatch):
    plans, observed = [], merging.observed

    def seen(df, tag, *figures):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return observed(df, tag, *figures)

    monkeypatch.setattr(merging, "observed", seen)
    rows = [(1, "a", None, None, "t u"), (2, "a", "x", None, "v w"), (3, None, "x", None, "t u"), (4, "b", None, None, "t u"), (5, None, None, None, None)]
    groups = merging.merge_groups(spark.createDataFrame(rows, "order long, doi string, arxiv_id string, semantic_scholar_id string, title string"))
    hits = spark.createDataFrame([(i, "p", "q", f"l{i}") for i in range(1, 6)], "order long, provider string, query_id string, label string")
    routes = spark.createDataFrame([(i, n, "p", f"u{i % 2}{n}") for i in range(1, 6) for n in (0, 1)], "order long, no int, provider string, url string")
    for df in (merging.merged_hits(hits, groups), merging.merged_routes(routes, groups)):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
    assert len(plans) > 3 and not any("Broadcast" in p for p in plans)
    assert sorted(map(tuple, groups.collect())) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)]


def test_toxicity_learns_from_all_labelled_rows(spark):
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        lang = "rare" if i % 50 == 7 else "l1" if i % 2 else "l2"
        w = words(rng, rng.randint(3, 30), {"rare": "qrstu", "l1": "abcde", "l2": "vwxyz"}[lang]).split() + [f"{lang[-1]}mark"]
        w.insert(rng.randrange(len(w)), "hhfoul") if i % 3 == 0 else None
        rows.append((i, " ".join(w), lang, int(i % 3 == 0)))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int").repartition(4)
    model = toxicity.train(table.drop("toxic"), table.select("doc_id", "toxic"), most=4)
    assert model.langs == ["l1", "l2", "rare"] and "emark" in model.tells  # the sample of four rows a label has none of the rare ones
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    names, tells = toxicity.telling([LETTERS.findall(r[1].lower()) for r in learned], [r[2] for r in learned])
    assert names == model.langs and tells.keys() == model.tells.keys() and all(np.allclose(tells[w], model.tells[w]) for w in tells)
    got = toxicity.score(table, model).where("held_out").select("toxic", "predicted").collect()
    assert sum(r.toxic == r.predicted for r in got) / len(got) > 0.9


def test_threshold_of_counts_is_that_of_rows():
    rng = np.random.default_rng(2)
    x, y = np.round(rng.normal(size=500), 1), (rng.random(500) < 0.3).astype(float)
    values = np.unique(x)
    ones, all_ = (np.array([(f(y[x == v])) for v in values]) for f in (np.sum, len))
    cut = toxicity.threshold(values, ones, prior=0.0, n=all_)
    f1 = lambda c: 2 * y[x >= c].sum() / ((x >= c).sum() + y.sum())
    assert f1(cut) >= max(f1(c) for c in values) - 1e-12
