"""Steps that findings of round 3 were about, third part."""

import math
import random

from pyspark.sql import functions as F

from quillspark.operators import cards, contexts, lexicon
from quillspark.plans import QUERIES
from quillspark.plans import cards as plans


def test_c_values_meet_their_parts_in_one_exchange(spark, monkeypatch):
    rng, stop = random.Random(5), ("the", "of")
    terms = {" ".join([rng.choice("abcd"), *(rng.choice(("a", "b", "c", "the", "of")) for _ in range(rng.randint(0, 4))), rng.choice("abcd")]): rng.randint(2, 9) for _ in range(400)}
    monkeypatch.setattr(lexicon, "PORTION", 50)
    df = spark.createDataFrame([(t, n, 2, len(t.split())) for t, n in terms.items()], "term string, total_count long, document_count long, size int").repartition(3)
    around: dict[str, list[int]] = {}
    for t, n in terms.items():
        w = t.split()
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                around.setdefault(" ".join(w[i : i + k]), []).append(n)
    mean = lambda t: sum(around[t]) / len(around[t]) if t in around else 0.0
    want = {t: max(0.0, math.log2(len(t.split())) * (n - mean(t))) for t, n in terms.items()}
    for ends in ((), stop):
        got = lexicon.c_values(df, ends)
        plan = got._jdf.queryExecution().sparkPlan().toString()
        assert "Join" not in plan and "Generate" not in plan
        rows = {r.term: r.c_value for r in got.collect()}
        assert rows.keys() == want.keys() and max(abs(v - want[t]) for t, v in rows.items()) < 1e-6
    assert lexicon.c_values(df.where("size < 3")).where("c_value > 0").count() == sum(len(t.split()) == 2 for t in terms)


def test_first_examples_are_dealt_out_once(spark, monkeypatch):
    monkeypatch.setattr(lexicon, "HELD", 3)
    rng = random.Random(7)
    pool = ["A red fox ran over all the wide fields.", "The fox and the  hen\tmet by an old red well!", "Short one.", "It's dis--cs and x's of a fox, red and red again?", "long " * 120 + "."]
    rows = [(rng.randint(1, 25), " \n".join(rng.choice(pool) for _ in range(rng.randint(0, 6)))) for _ in range(60)] + [(26, None), (27, ""), (None, pool[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    first: dict[str, dict[str, tuple]] = {}
    for d, t in rows:
        for i, s in enumerate(lexicon.SENTENCE_END.split(t or "")) if d is not None else ():
            s = " ".join(s.split())
            for w in {w.lower() for w in lexicon.WORD.findall(s) if len(w) > 1} if 35 <= len(s) <= 500 else ():
                first.setdefault(w, {})[s] = min((d, i), first.get(w, {}).get(s, (99, 0)))
    got = lexicon.examples(df.where("doc_id is not null"), most=2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "Join" not in plan  # one of them is the repartition above
    order = {w: sorted((p, s) for s, p in by.items())[:2] for w, by in first.items()}
    found: dict[str, list] = {}
    for r in got.orderBy("lemma", "rank").collect():
        found.setdefault(r.lemma, []).append((r.doc_id, r.sentence))
    # two sentences may share a place where a doc_id is repeated, so places and numbers are held against each other
    assert {w: [d for d, _ in x] for w, x in found.items()} == {w: [p[0] for p, _ in x] for w, x in order.items()}
    assert all(len({s for _, s in x}) == len(x) and all(s in first[w] for _, s in x) for w, x in found.items())


def test_review_sentences_are_pruned_before_the_exchange(spark):
    words = spark.createDataFrame([("a", "NOUN", [("a", 2)] * 6, ["why"], []), ("b", "NOUN", [], ["why"], []), ("c", "NOUN", [], [], [])], "lemma string, part_of_speech string, surface_forms array<struct<form:string,count:long>>, reasons array<string>, expansions array<string>")
    said = [("A ", i % 7, f"p{i % 3}", f" s{i}") for i in range(40)] + [("a", 0, "p0", " "), ("c", 1, "p", "s")]
    said = spark.createDataFrame(said, "lemma string, no int, paper_id string, sentence string")
    out = cards.review_batches(words, said)
    rows = {r.lemma: [tuple(s) for s in r.sentences] for r in out.collect()}
    assert rows == {"a": [(0, "p0", "s0"), (0, "p0", "s21")], "b": []}
    assert "WindowGroupLimit" in cards.first_sentences(said)._jdf.queryExecution().sparkPlan().toString()


def test_card_reasons_read_the_texts_twice(spark):
    plan = plans.reasons(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan  # words are a table by then


def test_words_of_papers_are_judged_once(spark):
    plan = QUERIES["paper_vocabulary"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 3 and "Union" not in plan  # of labelled texts; of all for the vocabulary and for their sum


def test_word_contexts_are_cut_where_a_text_is(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(80):
        s = "".join(rng.choice("abcdefghij   \n\t") if rng.random() < 0.97 else "é" * 90 for _ in range(rng.choice((10, 499, 500, 501, 700, 1500))))
        start = rng.randrange(len(s))
        rows.append((s, start, min(len(s), start + rng.randint(1, 9))))
    df = spark.createDataFrame(rows, "s string, a int, z int")
    assert [r[0] for r in df.select(contexts.window(F.col("s"), F.col("a"), F.col("z"))).collect()] == [contexts.window_of(*r) for r in rows]
    docs = spark.createDataFrame([(1, "Red fox. A red hen! Fox"), (1, "No. It is a red one"), (2, None), (3, "x " * 30_000 + "fox red")], "doc_id long, text string")
    out = contexts.word_contexts(docs, spark.createDataFrame([("red",), ("fox",), ("x",)], "lemma string"))
    got = sorted((r.doc_id, r.lemma, r.n, r.context) for r in out.collect())
    assert got[:4] == [(1, "fox", 2, "Red fox."), (1, "red", 3, "No."), (1, "red", 3, "Red fox."), (3, "fox", 1, got[3][3])]
    assert got[3][3].startswith("… x x") and got[3][3].endswith("x fox red") and got[5][1:3] == ("x", 30_000) and len(got) == 6
    assert "aggregate(" not in out._jdf.queryExecution().optimizedPlan().toString()  # of all words before, which copies a list for each
