"""Each stage of the pipeline against a plain version of its decision."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import mixing
from tests.llm.data import words
from tests.llm.test_operators import brute_components, check_packing, whole


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(300):
        w = words(rng, rng.randint(8, 60), "abcde" if i % 3 else "vwxyz").split()
        toxic = i % 6 == 1
        if toxic:
            w.insert(rng.randrange(len(w)), "hhfoul" + rng.choice("abc"))
        if i % 10 == 9:
            w = rows[-1][1].split() if i % 20 == 9 and not labels[-1][1] else w
        rows.append((i, " ".join(w), "l1" if i % 3 else "l2", rng.choice(("a", "b", "b", None)), 7))
        labels.append((i, int("hhfoul" in rows[-1][1])))
    rows += [(500, None, None, None, None), (501, "", "l1", "a", 0), (502, "123 !?", "l1", "a", 1)]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages_one_after_another(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, rows = docs.columns, docs.collect()
    stage = dict(corpus_pipeline.STAGES)

    kept = corpus_pipeline.written(stage["toxicity"](spark, docs, sf_dir), "t")
    assert kept.columns == columns
    foul = {r.doc_id for r in rows if "hhfoul" in (r.text or "")}
    ids = {r.doc_id for r in kept.collect()}
    assert len(ids & foul) <= 0.1 * len(foul) and len({r.doc_id for r in rows} - foul - ids) <= 3

    told = corpus_pipeline.written(stage["language_id"](spark, kept, sf_dir), "t")
    assert told.columns == columns and ids - {r.doc_id for r in told.collect()} == {500, 501, 502} & ids

    one = corpus_pipeline.written(stage["ngram_join"](spark, told, sf_dir), "t")
    label, _ = brute_components(told.collect())
    assert one.columns == columns and sorted(r.doc_id for r in one.collect()) == sorted(set(label.values()))

    mixed = corpus_pipeline.written(stage["mixing"](spark, one, sf_dir), "t")
    share = {r.doc_id: r.taken / r.size for r in mixing.mix(one).collect()}
    copies = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == columns and all(abs(copies[d] - s) <= 0.5 for d, s in share.items())

    expected = defaultdict(list)
    held = mixed.collect()
    for r, x in zip(held, whole([r.text for r in held])):
        expected[r.doc_id].append(x + [1])
    check_packing(stage["packing"](spark, mixed, sf_dir).collect(), expected)


def test_run_and_clashing_columns(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({"score": F.lit("s"), "predicted": F.lit(1), "_row": F.lit(2), "a.b": F.lit(3)})
    for name in ("toxicity", "language_id", "ngram_join", "mixing"):
        assert dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir).columns == docs.columns


def test_null_and_repeated_ids_and_empty_tables(spark, sf_dir):
    rng = random.Random(3)
    a, b, c, d = (words(rng, 40) for _ in range(4))
    near = " ".join(a.split()[:-1])
    rows = [(None, b), (None, c), (None, None), (9, a), (4, near), (4, d), (7, d), (7, d), (12, ""), (13, ""), (None, a)]
    docs = spark.createDataFrame([(i, t, "l1", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = dict(corpus_pipeline.STAGES)["ngram_join"](spark, docs, sf_dir).collect()
    want = Counter({(None, b): 1, (None, c): 1, (None, None): 1, (4, near): 1, (4, d): 1, (12, ""): 1, (13, ""): 1})
    assert Counter((r.doc_id, r.text) for r in kept) == want
    mixed = Counter((r.doc_id, r.text) for r in dict(corpus_pipeline.STAGES)["mixing"](spark, docs, sf_dir).collect())
    assert mixed == Counter((i, t) for i, t in rows if t)  # one source: all of it, once
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.limit(0), sf_dir)
        assert none.count() == 0 and (name == "packing" or none.columns == docs.columns)


def test_mixed_languages_stay(spark, sf_dir):
    rng = random.Random(9)
    rows = [(i, words(rng, 20, "abcde" if i % 2 else "vwxyz"), "l1" if i % 2 else "l2") for i in range(200)]
    rows += [(1000 + i, words(rng, 20, "abcde") + " " + words(rng, 20, "vwxyz"), None) for i in range(10)] + [(2000, "½ ² ① 12", "l1")]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in dict(corpus_pipeline.STAGES)["language_id"](spark, docs, sf_dir).collect()}
    assert got == {r[0] for r in rows} - {2000}
