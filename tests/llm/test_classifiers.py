"""The classifiers' numpy code against plain loops, and their rules on awkward tables."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import langid, toxicity
from quillspark.llm.common import LETTERS
from tests.llm.data import empty, words


def labelled(rng, n=160):
    texts, labels, langs = [], [], []
    for i in range(n):
        lang = "l1" if i % 2 else "l2"
        w = words(rng, rng.randint(1, 30), "abcde" if i % 2 else "vwxyz").split() + (["eb", "da"] if i % 2 else ["vy", "zu"])
        if i % 3 == 0:
            w.insert(rng.randrange(len(w)), "hhfoul")
        texts.append(" ".join(w))
        labels.append(int(i % 3 == 0))
        langs.append(lang)
    return texts, labels, langs


@pytest.fixture(scope="module")
def model():
    return toxicity.fit(*labelled(random.Random(1)))


def plain(m, text):
    """Output of the network for one text, word by word, and the language's place."""
    ws = LETTERS.findall(text.lower())
    e = []
    for w in ws:
        v = np.zeros(toxicity.DIM)
        for f in toxicity.features(w):
            v += m.embed[toxicity.hashed([f], toxicity.BUCKETS)[0]]
        e.append(v)
    hidden = []
    for k, f in enumerate(m.filters):
        for c in range(toxicity.FILTERS):
            responses = []
            for at in range(len(ws)):
                responses.append(sum(float(e[at + j] @ f[j][:, c]) for j in range(len(f)) if at + j < len(ws)))
            hidden.append(max([0.0, max(responses) + m.bias[k * toxicity.FILTERS + c]]) if responses else 0.0)
    tells = [sum(float(m.tells[w][k]) for w in ws if w in m.tells) for k in range(len(m.langs))]
    told = [w for w in ws if w in m.tells]
    return float(np.dot(hidden, m.out)) + m.last, int(np.argmax(tells)) if told and any(tells) else len(m.langs)


def test_network_matches_plain_loops(model):
    rng = random.Random(4)
    texts = ["", "hhfoul", "a hhfoul", words(rng, 3, "abcde"), words(rng, 70, "vwxyz"), "12 !?", "hhfoul " * 40, "ßé hhfoul eb", words(rng, 9, "qrst")]
    got, lang = model.logits(*toxicity._values(toxicity.WordTable(model.word_values), texts))
    for x, k, text in zip(got, lang, texts):
        want = plain(model, text)
        assert abs(x - want[0]) < 1e-3 and (k == want[1] or not LETTERS.findall(text))


def test_language_is_learned_from_the_texts(model):
    assert model.langs == ["l1", "l2"] and model.shift.shape == (3,)
    texts = ["abcde eb da bca", "vwxyz vy zu xyz"]
    assert model.logits(*toxicity._values(toxicity.WordTable(model.word_values), texts))[1].tolist() == [0, 1]
    none = toxicity.fit(*labelled(random.Random(1))[:2])
    assert none.langs == [] and none.shift.shape == (1,)


def test_threshold_is_the_best_cut():
    rng = np.random.default_rng(3)
    y = (rng.random(200) < 0.4).astype(float)
    x = y * 2 + rng.normal(size=200)
    cut = toxicity.threshold(x, y, prior=0.0)
    f1 = lambda c: 2 * y[x >= c].sum() / ((x >= c).sum() + y.sum())
    assert f1(cut) >= max(f1(c) for c in x) - 1e-12
    assert toxicity.threshold(x[:10], y[:10]) == 0.0 and toxicity.threshold(x, np.ones(200)) == 0.0


def test_scores_of_repeats_nulls_and_ties(spark, model):
    rows = [(1, "a hhfoul eb"), (1, "a hhfoul eb"), (None, "a hhfoul eb"), (2, None), (3, ""), (4, "½ ² ①")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"predicted": F.lit("x"), "score": F.lit("y"), "held_out": F.lit(3)})
    got = toxicity.score(docs, model).collect()
    assert len(got) == 6 and len({r.score for r in got if r.text == rows[0][1]}) == 1
    assert len({r.score for r in got if r.doc_id in (2, 3, 4)}) == 1
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    even = toxicity.fit(["a b"] * 4, [1, 0, 1, 0][:4])
    even.out[:], even.last = 0, 0.0
    assert [r.predicted for r in toxicity.score(docs.limit(1), even).collect()] == [1]  # a score of exactly 0.5
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (None, 1)], "doc_id long, toxic int")
    texts, ys, langs = toxicity.sample(docs, labels, 10, 100)
    assert sorted(zip(texts, ys)) == [("a hhfoul eb", 1)] * 2 and langs == [None, None]
    assert toxicity.score(empty(spark), model).count() == 0


def test_languages_of_symbols_repeats_and_ties(spark):
    rng = random.Random(7)
    texts = [words(rng, 20, "abcde" if i % 2 else "vwxyz") for i in range(100)]
    m = langid.fit(texts, ["l1" if i % 2 else "l2" for i in range(100)])
    rows = [(1, "½ ² ① ⅷ"), (2, "५ १२"), (3, texts[1]), (3, texts[1]), (None, texts[0]), (5, "é" * 3 + " abcde cab"), (6, " ".join(texts[1::2]) * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang_pred", F.lit(1))
    got = langid.identify(docs, m).collect()
    by = {r.doc_id: (r.lang_pred, r.score, r.sure) for r in got}
    assert by[1] == by[2] == ("und", 0.0, 0.0) and by[3][0] == by[6][0] == "l1" and by[None][0] == "l2" and len(got) == len(rows)
    m.weights[:], m.moves[:], m.start[:] = 0, 0, 0
    tied = langid.identify(docs.where("doc_id = 3"), m).first()
    assert tied.lang_pred == "l1" and abs(tied.score - 0.5) < 1e-9 and abs(tied.sure - 0.5) < 1e-9
    assert langid.identify(empty(spark), m).count() == 0


def test_posteriors_of_long_texts_match_a_plain_forward_backward():
    rng = np.random.default_rng(6)
    m = langid.Model(["a", "b", "c"], np.zeros((langid.BUCKETS, 3)), rng.normal(size=(3, 3)), rng.normal(size=3), {})
    counts = np.array([1, 700, 0, 97, 2])
    e = np.exp(rng.normal(size=(int(counts.sum()), 3)) * 2)
    e /= e.max(1, keepdims=True)
    want, at = [], 0
    for n in counts:
        x, at = e[at : at + n], at + n
        if not n:
            continue
        alpha, beta = np.zeros((n, 3)), np.ones((n, 3))
        for t in range(n):
            alpha[t] = (np.exp(m.start) if t == 0 else alpha[t - 1] @ np.exp(m.moves)) * x[t]
            alpha[t] /= alpha[t].sum()
        for t in range(n - 2, -1, -1):
            beta[t] = np.exp(m.moves) @ (beta[t + 1] * x[t + 1])
            beta[t] /= beta[t].sum()
        want.append(alpha * beta / (alpha * beta).sum(1, keepdims=True))
    for block in (1, 7, 96, 1000):
        assert abs(langid.posteriors(m, e, counts[counts > 0], block) - np.concatenate(want)).max() < 1e-9
