"""Paged provider responses along cursors, feeds, prefixes and merged records on literal rows."""

import json


from quillspark.operators import providers, reaggregation
from quillspark.sources import feeds, paged

FEED = """<?xml version="1.0" encoding="UTF-8"?>
<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><title>ArXiv Query</title><id>http://arxiv.org/api/x</id>
<entry><id>http://arxiv.org/abs/2401.00001v1</id><updated>2024-01-01T00:00:00Z</updated><published>2024-01-01T00:00:00Z</published><title>Old
  title</title><summary> An  abstract &lt;b&gt; &amp; more. </summary><author><name>A. One</name></author><link href="http://arxiv.org/pdf/2401.00001v1" rel="related" type="application/pdf" title="pdf"/></entry>
<entry><id>http://arxiv.org/abs/2401.00001v12</id><updated>2024-03-01T00:00:00Z</updated><published>2024-01-01T00:00:00Z</published><title>New title</title><summary>S</summary><author><name>A. One</name></author><author><name> B.
 Two</name></author><arxiv:doi>https://doi.org/10.1/AB</arxiv:doi><link href="http://arxiv.org/abs/2401.00001v12" rel="alternate"/><link href="http://arxiv.org/pdf/2401.00001v12" title="pdf"/><arxiv:primary_category term="cs.LG"/><category term="cs.LG"/><category term="stat.ML"/></entry>
<entry><id>http://arxiv.org/abs/hep-th/9901001</id><title/><summary/></entry>
<entry><id>http://example.org/none</id><title>not one</title></entry></feed>
"""


def test_feed(spark, tmp_path):
    (tmp_path / "a.xml").write_text(FEED)
    got = {r.candidate_id: r for r in feeds.feed_candidates(feeds.entries(spark, str(tmp_path))).collect()}
    assert set(got) == {"arXiv:2401.00001", "arXiv:hep-th/9901001"}
    r = got["arXiv:2401.00001"]
    assert (r.version, r.title, r.authors, r.categories, r.doi, r.updated) == (12, "New title", ["A. One", "B. Two"], ["cs.LG", "stat.ML"], "10.1/AB", "2024-03-01")
    assert r.pdf_url == "https://arxiv.org/pdf/2401.00001v12" and got["arXiv:hep-th/9901001"].pdf_url == "https://arxiv.org/pdf/hep-th/9901001"


def test_request_hash():
    assert paged.canonical({"b": 1, "a": ["ü", None]}) == '{"a":["ü",null],"b":1}'
    assert paged.request_hash({"a": "1", "b": "2"}) == paged.request_hash({"b": "2", "a": "1"}) != paged.request_hash({"a": "2", "b": "1"})


def page(folder, query, cursor, works, following, count=9):
    return paged.put_page(folder, {"request": paged.request_of(query, cursor), "meta": {"count": count, "next_cursor": following}, "results": works})


def test_paged(spark, tmp_path, capsys):
    folder, a, b, c = f"file://{tmp_path}", {"id": "a", "query": "deep nets"}, {"id": "b", "query": "graphs", "filter": "year:2020"}, {"id": "c", "query": "nowhere"}
    works = [{"id": f"W{i}", "title": f"t{i}", "doi": None, "year": 2000 + i} for i in range(9)]
    page(folder, a, "*", [works[0], works[1], {"title": "no id"}, works[0]], "x")
    page(folder, a, "x", [works[1], works[2], works[3]], "y")
    beyond = page(folder, a, "y", [works[4]], None)
    (tmp_path / beyond).write_text("{broken")
    page(folder, b, "*", [works[5], {"id": "W6", "year": "n.d."}], None)
    read = lambda **k: paged.read_paged(spark, folder, [a, b, c], **k)
    got = read(quota=4)
    assert sorted((r.query_id, r["rank"], r.candidate_id, r.year) for r in got.collect()) == [("a", 0, "W0", 2000), ("a", 1, "W1", 2001), ("a", 2, "W2", 2002), ("a", 3, "W3", 2003), ("b", 0, "W5", 2005), ("b", 1, "W6", None)]
    told = {r.query_id: r for r in read(quota=4, report="attempts").collect()}
    assert (told["a"].status, told["a"].retained, told["a"].fetched, told["a"].total) == ("ok", 4, 7, 9)  # the page beyond the quota is not read: it is broken
    assert told["c"].status == "failed" and "not recorded" in told["c"].message and told["b"].status == "ok"
    assert {r.query_id: r.status for r in read(quota=5, report="attempts").collect()}["a"] == "failed"
    some = got.where("query_id = 'a' and year >= 2002")
    assert [r.candidate_id for r in some.orderBy("rank").collect()] == ["W2", "W3"]
    some.explain("formatted")
    assert "PushedFilters: [EqualTo(query_id,a), GreaterThanOrEqual(year,2002)]" in capsys.readouterr().out and some.rdd.getNumPartitions() == 1  # the other chains are not opened


def test_fetched_pages_are_recorded(spark, tmp_path):
    log = tmp_path / "asked"

    class Provider(paged.PagedResponses):
        tried = str(log)

        @classmethod
        def name(cls):
            return "provider"

        @staticmethod
        def fetch(request):
            with open(log, "a") as f:
                f.write(json.dumps(request) + "\n")
            if sum(1 for _ in open(log)) == 1:
                raise OSError("try again")
            return {"meta": {"count": 1, "next_cursor": None}, "results": [{"id": "W1", "title": "t", "doi": None, "year": 2001}]}

    for _ in range(2):
        got = paged.read_paged(spark, f"file://{tmp_path}/pages", [{"id": "q", "query": "x"}], 5, source=Provider)
        assert [tuple(r) for r in got.collect()] == [("q", 0, "W1", "t", None, 2001)]
    assert len(log.read_text().splitlines()) == 2  # one that failed, one that was recorded


def test_new_pages(spark, tmp_path):
    folder, out = f"{tmp_path}/pages", f"{tmp_path}/out"
    q = {"id": "a", "query": "deep"}

    def drain():
        s = paged.new_pages(spark, folder).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/log").option("path", out).trigger(availableNow=True).start()
        s.awaitTermination()
        return sorted((r.cursor, r.at, r.candidate_id) for r in spark.read.parquet(out).collect())

    page(folder, q, "*", [{"id": "W1", "title": "t", "doi": None, "year": 1}], "x")
    assert drain() == [("*", 0, "W1")]
    page(folder, q, "x", [{"id": "W2", "title": "t", "doi": None, "year": 1}], None)
    assert drain() == [("*", 0, "W1"), ("x", 0, "W2")]


def test_excluded_titles(spark):
    titles = spark.createDataFrame([(1, "Retraction: of x"), (2, "A retraction"), (3, "Re"), (4, None), (5, "Correction to y")], "id long, title string")
    heads = lambda *p: spark.createDataFrame([(x,) for x in p], "prefix string")
    assert sorted(r.id for r in providers.excluded_titles(titles, heads("RETRACTION", "correction to")).collect()) == [1, 5]
    assert sorted(r.id for r in providers.excluded_titles(titles, heads("re")).collect()) == [1, 3]
    assert providers.excluded_titles(titles, heads("--")).count() == 5 and providers.excluded_titles(titles, heads().where("false")).count() == 0
    many = [f"p{i} word" for i in range(3000)] + ["a retr"]
    assert [r.id for r in providers.excluded_titles(titles, heads(*many)).collect()] == [2]


def test_merged_records(spark):
    docs = spark.createDataFrame([(i,) for i in (1, 2, 3)], "doc_id long")
    vocab = spark.createDataFrame([("models", "NOUN", 3, 2, 0.5), ("model", "VERB", 3, 2, 0.4), ("modle", "NOUN", 1, 1, 0.1), ("junk", "X", 9, 3, 0.9)], "lemma string, part_of_speech string, total_count long, document_count long, dispersion double")
    decisions = spark.createDataFrame([("models", "replace", "model"), ("modle", "replace", "model"), ("junk", "drop", None), ("model", "keep", None)], "lemma string, action string, target string")
    into = reaggregation.targets(vocab, decisions)
    counts = spark.createDataFrame([(1, "models", 2), (2, "models", 1), (1, "model", 1), (3, "model", 2), (2, "modle", 1), (1, "junk", 9)], "doc_id long, lemma string, n long")
    r = reaggregation.merged_records(vocab, counts, into, docs, 16).collect()
    assert [(x.lemma, x.part_of_speech, x.total_count, x.document_count, x.document_share, x.frequency_per_million) for x in r] == [("model", "NOUN", 7, 3, 1.0, 437500.0)]
    forms = spark.createDataFrame([("models", "Models", 2, 1), ("models", "models", 1, 2), ("model", "model", 3, 1), ("modle", "models", 1, 1), ("junk", "junk", 9, 1)], "lemma string, form string, n long, rank int")
    assert [(x.form, x.n) for x in reaggregation.merged_forms(forms, into).orderBy("rank").collect()] == [("model", 3), ("Models", 2), ("models", 2)]
    examples = spark.createDataFrame([("model", 1, 3, "m1"), ("models", 1, 1, "s1"), ("models", 2, 2, "s2"), ("modle", 1, 1, "s1"), ("modle", 2, 2, "x"), ("model", 2, 3, "")], "lemma string, rank int, doc_id long, sentence string")
    assert [(x.doc_id, x.sentence) for x in reaggregation.merged_examples(examples, into).orderBy("rank").collect()] == [(1, "s1"), (2, "s2"), (3, "m1")]
