"""What queries deal out between tasks: no whole sentences for each of their words, no texts more than once."""

import random

from pyspark.sql import functions as F

from quillspark.operators import briefs, chunking, contexts, learning, search
from quillspark.plans import sources

DATA = "/root/testdata/sf0.001"


def dealt(df):
    """Columns of each exchange of a plan."""
    plan = df._jdf.queryExecution().executedPlan()
    open_nodes, out = [plan.initialPlan() if "Adaptive" in plan.nodeName() else plan], []
    while open_nodes:
        node = open_nodes.pop()
        if node.nodeName() == "Exchange":
            out.append([x.split("#")[0] for x in node.output().mkString(",").split(",")])
        open_nodes += [node.children().apply(i) for i in range(node.children().size())]
    return out


def unbroadcast(spark, made):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return made()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_unfamiliar_words(spark):
    docs = spark.createDataFrame([(2, "The red fox. A fox!"), (1, "No. Red  fox here."), (3, None)], "doc_id long, text string")
    unknown = spark.createDataFrame([("fox",), ("red",), ("red",), ("blue",)], "lemma string")
    got = unbroadcast(spark, lambda: briefs.unfamiliar(docs, unknown))
    assert [tuple(r) for r in got.collect()] == [("fox", 3, "Red fox here."), ("red", 2, "Red fox here.")]
    assert not any("sentence" in columns for columns in unbroadcast(spark, lambda: dealt(got)))


def test_index_of_a_text(spark):
    """Only texts are dealt out, once."""
    assert dealt(sources.abstract_from_index(spark, DATA)) == [["doc_id", "text"]]


def test_first_examples_fetch_sentences(spark):
    """Rows with marks alone give the sentences that are shown."""
    docs = spark.createDataFrame([(1, "Models of large systems can be quite useful. Short one.\nModels of large systems can be quite useful."), (2, "There are other models of large systems here as well.")], "doc_id long, text string")
    sents = chunking.annotated(docs).withColumn("mark", chunking.mark(F.col("sentence")))
    words = chunking.content(sents, "mark").select("lemma", "doc_id", "pos.part", "pos.sent", "mark")
    got = chunking.first_examples(words, "lemma", chunking.plain_sentences(docs)).where("lemma = 'model'").orderBy("rank")
    assert [tuple(r) for r in got.collect()] == [("model", 1, 1, "Models of large systems can be quite useful."), ("model", 2, 2, "There are other models of large systems here as well.")]


def test_containing_deals_no_texts_by_their_runs(spark):
    """A text is spread as a number, not as itself."""
    words = spark.createDataFrame([("abc",), ("bcdefg",), ("",), ("a",), ("xyzxyzxyzxyzxyzxyz",)], "s string")
    texts = spark.createDataFrame([("zabcdefgh",), ("ab",), ("",), (None,), ("xyzxyzxyzxyzxyzxyzx",), ("xyzxyzxyzxyzxyzxy",)], "t string")
    got = unbroadcast(spark, lambda: search.containing(words, "s", texts, "t"))
    want = {("abc", "zabcdefgh"), ("bcdefg", "zabcdefgh"), ("a", "zabcdefgh"), ("a", "ab"), ("xyzxyzxyzxyzxyzxyz", "xyzxyzxyzxyzxyzxyzx")}
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert not any("_gram" in columns and "t" in columns for columns in unbroadcast(spark, lambda: dealt(got)))


def test_fuzzy_counts(spark):
    """As many names, and the least, as the search of each finds."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
    names = spark.createDataFrame([(x,) for x in sorted({" ".join(word() for _ in range(rng.randint(1, 4))) for _ in range(120)})], "name string")
    queries = spark.createDataFrame([(x,) for x in sorted({word() for _ in range(40)})], "query string")
    want = learning.fuzzy_search(names, queries).groupBy("query").agg(F.count(F.lit(1)).alias("matches"), F.min("name").alias("first_name"))
    assert sorted(tuple(r) for r in learning.fuzzy_counts(names, queries).collect()) == sorted(tuple(r) for r in want.collect())


def test_contexts_meet_by_all_words(spark):
    """A term meets the sentences that have its words in a row, not all that have its rarest word; contexts are not dealt out."""
    docs = spark.createDataFrame([(1, "Deep nets learn. Nets go deep.  Deep, nets! We like deep nets now."), (2, "Deep ends. Nets end."), (3, None)], "doc_id long, text string")
    forms = spark.createDataFrame([("deep nets", "deep nets", 0), ("...", "...", 0)], "term string, form string, rank int")
    got = unbroadcast(spark, lambda: contexts.term_contexts(docs, forms))
    assert [tuple(r) for r in got.collect()] == [(1, "deep nets", "We like deep nets now.")]
    assert not any("context" in x or "sentence" in x for columns in unbroadcast(spark, lambda: dealt(got)) for x in columns)
