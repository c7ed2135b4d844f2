"""Strategies, attempts and accumulated candidates; words of papers and the order of terms."""

import hashlib
import json

from quillspark.operators import papers, retrieval
from quillspark.streaming.snapshots import Snapshots


def strategy(seq, name="s", providers=("openalex",), queries=(("1", "l", "deep nets", None),), feeds=None, primary="f", categories=None, start="2020", end=None):
    return (seq, name, None if providers is None else list(providers), None if queries is None else list(queries), feeds, primary, categories, start, end)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), retrieval.STRATEGY)


def test_fingerprint(spark):
    a = [("1", "x", " deep nets ", 50), ("2", "y", "graphs", None)]
    b = [("8", "other", "graphs", 100), ("9", "names", "deep nets", 50)]
    feeds = [("1", "l", ["p"], None, None), ("2", "l", ["a", "b"], ["cs"], "all")]
    rows = [strategy(1, queries=a), strategy(2, "t", queries=b), strategy(3, queries=a, end="2021"), strategy(4, providers=("arxiv", "openalex"), feeds=feeds), strategy(5, providers=("openalex", "arxiv"), feeds=feeds[::-1]), strategy(6, queries=[("1", "x", "naïve ü", None)])]
    got = {r.seq: r.f for r in frame(spark, *rows).select("seq", retrieval.fingerprint().alias("f")).collect()}
    assert got[1] == got[2] != got[3] and got[4] == got[5] and len(set(got.values())) == 4
    said = {"arxiv_categories": None, "arxiv_search_queries": [], "openalex_primary_filter": "f", "providers": ["openalex"], "publication_from_date": "2020", "publication_to_date": None, "search_queries": [{"query": "naïve ü", "candidate_limit": 100}]}
    assert got[6] == hashlib.sha256(json.dumps(said, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:24]


def test_violations(spark):
    good = [("1", "l", ["p"], ["c"], None)]
    rows = [
        strategy(1), strategy(2, " "), strategy(3, providers=()), strategy(4, providers=("openalex", "openalex")), strategy(5, providers=("web",)), strategy(6, queries=None), strategy(7, queries=[("1", "", "q", 5)]), strategy(8, primary=None),
        strategy(9, providers=("arxiv",), queries=None, feeds=None), strategy(10, providers=("arxiv",), queries=None, feeds=[("1", None, ["p"], ["c"], None)]), strategy(11, providers=("arxiv",), queries=None, feeds=[("1", "l", [], ["c"], None)]),
        strategy(12, providers=("arxiv",), queries=None, feeds=[("1", "l", ["p"], None, None)]), strategy(13, providers=("arxiv",), queries=None, feeds=[("1", "l", ["p"], None, None)], categories=["c"]), strategy(14, providers=("arxiv",), queries=None, feeds=good), strategy(15, providers=None),
    ]
    got = {r.seq: r.violation for r in retrieval.strategy_violations(frame(spark, *rows)).collect()}
    assert got == {2: "no id", 3: "providers", 4: "providers", 5: "providers", 6: "no queries", 7: "a query without id, label or text", 8: "no primary filter", 9: "no feed queries", 10: "a feed query without id or label", 11: "a feed query without phrases or categories", 12: "a feed query without phrases or categories", 15: "providers"}


def test_attempts(spark):
    run = lambda *f: {r.seq: (r.number, r.outcome) for r in retrieval.attempts(spark.createDataFrame(list(enumerate(f)), "seq long, fingerprint string")).collect()}
    assert run("a", "a", "b", "b", "c", "a", "d") == {0: (1, "taken"), 1: (None, "duplicate"), 2: (2, "taken"), 3: (None, "duplicate"), 4: (3, "taken"), 5: (None, "too many"), 6: (None, "too many")}
    assert run("a", "a") == {0: (1, "taken"), 1: (None, "duplicate")}


def test_accumulated(spark, tmp_path):
    store = Snapshots(spark, f"file://{tmp_path}/store", retrieval.FOUND, "identity", buckets=3)
    rows = lambda *r: spark.createDataFrame(list(r), "identity string, at int, title string")
    assert retrieval.accumulate(store, rows(("a", 1, "A"), ("b", 2, "B"), ("a", 3, "A again"), ("", 4, "none")), 1) == {"number": 1, "candidate_count_before": 0, "new_candidate_count": 2, "total_candidate_count": 2}
    second = rows(("b", 1, "B two"), ("c", 2, "C"))
    want = {"number": 2, "candidate_count_before": 2, "new_candidate_count": 1, "total_candidate_count": 3}
    assert retrieval.accumulate(store, second, 2) == want == retrieval.accumulate(store, second, 2)  # done again after a crash
    assert sorted(tuple(r) for r in store.read().collect()) == [("a", 1, 1, "A", [1]), ("b", 1, 2, "B", [1, 2]), ("c", 2, 2, "C", [2])]


def test_paper_vocabulary(spark):
    whole = ("p1", " Net ", "NOUN", "网", "net", "A net.", "e1", "Graph")
    words = [whole, ("p2", *whole[1:]), ("p1", "a", "NOUN", " ", "", "c", "e", "s"), ("p1", "b", "NOUN", "m", "", None, "e", "s"), ("p1", "c", "NOUN", "m", "", "c", "", "s"), ("p1", "d", "NOUN", "m", "", "c", "e", None)]
    words = spark.createDataFrame(words, "paper_id string, lemma string, part_of_speech string, meaning_zh string, meaning_en string, context string, evidence_context_id string, sense_key string")
    shown = spark.createDataFrame([("p1", "One", "u")], "paper_id string, title string, source_url string")
    good, bad = papers.paper_vocabulary(words, shown, spark.createDataFrame([], "item_id string, status string"))
    first = good.first()
    assert good.count() == 1 and (first.lemma, first.source_title, first.status) == ("net", "One", "new")
    assert {(r.paper_id, r.lemma): r.violation for r in bad.collect()} == {("p2", "net"): "no such paper", ("p1", "a"): "no meaning", ("p1", "b"): "no context", ("p1", "c"): "no evidence", ("p1", "d"): "no sense"}
    known = spark.createDataFrame([(first.item_id, "mastered")], "item_id string, status string")
    assert papers.paper_vocabulary(words, shown, known)[0].first().status == "mastered"
    sources = spark.createDataFrame([("i", "p1"), ("i", "p1"), ("j", "p1"), ("k", "p9")], "item_id string, paper_id string")
    items = spark.createDataFrame([("i",), ("j",), ("k",), ("i",)], "item_id string")
    assert [tuple(r) for r in papers.used_papers(items, sources, shown).collect()] == [("p1", "One", 2)]


def test_term_list(spark):
    terms = spark.createDataFrame([("b", 2, 5), ("a", 2, 5), ("c", 9, 9), ("d", 2, 6), ("e", 1, 1)], "term string, document_count long, total_count long")
    order = lambda df: [r.term for r in df.orderBy("place").collect()]
    assert order(papers.term_list(terms)) == ["c", "d", "a", "b", "e"]
    assert order(papers.term_list(terms, terms.where("term in ('e', 'b')").select("term"))) == ["b", "e", "c", "d", "a"]
