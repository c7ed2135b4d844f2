"""Contexts of terms and windows around words, against the plain rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.operators import contexts


def longest(text, forms):
    flat, found = re.sub(r"\s+", " ", text), []
    for form in forms:
        found += [m.strip() for m in re.findall(rf"(?is)([^.!?]{{0,420}}\b{re.escape(form)}\b[^.!?]{{0,420}}[.!?])", flat)]
    return max(found, key=len) if found else None


def test_term_contexts(spark):
    rng = random.Random(7)
    vocab = ["neural", "network", "net", "work", "deep-net", "a", "the", "x1", "Été", "graph"]
    texts = [" ".join(rng.choice(vocab) + rng.choice(("", "", "", ",", ".", "!")) for _ in range(n)) for n in (0, 3, 30, 60, 200, 200, 400, 900)]
    texts += [None, "no mark neural network", "Neural\n network.", "b" * 500 + " neural network " + "c" * 500 + " neural network " + "d " * 100 + ".", "neural network" + " z" * 209 + ".", "neural network" + " z" * 210 + ".", "neural network" + " z" * 211 + ".", "x" * 400 + " neural network" + "y" * 9 + " neural network."]
    forms = [("nn", "neural network", 0), ("nn", "net work", 1), ("g", "graph", 0), ("d", "deep-net", 0), ("e", "été", 0), ("q", "quark", 0), ("m", "a. b", 0), ("t", "the", 0), ("x", "x1 the", 0)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.term): r.context for r in contexts.term_contexts(docs, spark.createDataFrame(forms, "term string, form string, rank int")).collect()}
    by = {}
    for term, form, _ in forms:
        if "." not in form:
            by.setdefault(term, []).append(form)
    want = {(i, t): c for i, x in enumerate(texts) if x for t, f in by.items() if (c := longest(x, f))}
    assert got == want and len(want) > 20


def plain_window(s, start, end, limit=500):
    """Slow: every step on characters."""
    if len(s) <= limit:
        return " ".join(s.split())
    left = max(0, (start + end) // 2 - limit // 2)
    right = min(len(s), left + limit)
    left = max(0, right - limit)
    a, b = left, right
    if left:
        a = next((i + 1 for i in range(left, min(start, left + 80)) if s[i] == " "), left)
    if right < len(s):
        last = [i for i in range(max(end, right - 80), right) if s[i] == " "]
        if last and last[-1] > end:
            b = last[-1]
    return ("… " if a else "") + " ".join(s[a:b].split()) + (" …" if b < len(s) else "")


def test_windows(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(120):
        s = "".join(rng.choice("abcdefghij   ") if rng.random() < 0.97 else "x" * 90 for _ in range(rng.choice((10, 499, 500, 501, 700, 1500))))
        start = rng.randrange(len(s))
        rows.append((s, start, min(len(s), start + rng.randint(1, 9))))
    df = spark.createDataFrame(rows, "s string, a int, z int")
    got = [r[0] for r in df.select(contexts.window(F.col("s"), F.col("a"), F.col("z"))).collect()]
    assert got == [plain_window(*r) for r in rows]


def test_word_contexts(spark):
    texts = ["Alpha beta. Gamma alpha, ALPHA!  beta2 gamma", None, "", "1 2 3.", "delta " * 200 + "alpha " + "delta " * 200]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = spark.createDataFrame([("alpha",), ("beta",), ("alpha",)], "lemma string")
    got = {(r.doc_id, r.lemma): (r.n, r.context) for r in contexts.word_contexts(docs, words).collect()}
    assert got[0, "alpha"] == (3, "Alpha beta.") and got[0, "beta"] == (2, "Alpha beta.") and got[4, "alpha"][1] == plain_window(texts[4], 1200, 1205)
    assert set(got) == {(0, "alpha"), (0, "beta"), (4, "alpha")}
    top = contexts.word_contexts(docs, words, most=1).collect()
    assert sorted((r.doc_id, r.lemma) for r in top) == [(0, "alpha"), (4, "alpha")]


def test_term_rows(spark):
    terms = spark.createDataFrame([("Neural net", 5, 2), ("bare", 3, 1)], "term string, total_count long, document_count long")
    found = spark.createDataFrame([(1, "Neural net", "A neural net."), (2, "Neural net", "The net."), (1, "bare", "Bare.")], "doc_id long, term string, context string")
    told = spark.createDataFrame([("neural NET", "m", "中", "role", " "), ("bare", "m", "", "role", None)], "term string, meaning_en string, meaning_zh string, concept_role string, sense_key string")
    papers = spark.createDataFrame([(1, "One", "u1"), (2, "Two", "u2")], "doc_id long, title string, url string")
    none = spark.createDataFrame([], "item_id string, status string")
    rows = contexts.term_rows(terms, found, told, papers, none).collect()
    assert sorted((r.doc_id, r.title, r.context, r.sense_key, r.status) for r in rows) == [(1, "One", "A neural net.", "neural net", "new"), (2, "Two", "The net.", "neural net", "new")]
    known = spark.createDataFrame([(rows[0].item_id, "mastered")], "item_id string, status string")
    assert {r.status for r in contexts.term_rows(terms, found, told, papers, known).collect()} == {"mastered"}
    sourced = contexts.with_sources(terms, found)
    assert sorted(r.term for r in contexts.terms_of_paper(sourced, 1).collect()) == ["Neural net", "bare"] and [r.term for r in contexts.terms_of_paper(sourced, 2).collect()] == ["Neural net"]
