"""Queries over retrieval attempts, the words of papers, and the order of terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import lexicon as lx
from quillspark.operators import papers, retrieval, search
from quillspark.plans.base import query, table
from quillspark.plans.lexicon import TERMS, VOCAB, documents, terms, vocab
from quillspark.shared import new_path, written
from quillspark.streaming.snapshots import Snapshots

TITLE = "split_part(text, chr(10), 1)"


def strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A strategy for each source, in the order of its first document: it asks for its languages and the tens of thousands of its letters."""
    docs = table(spark, sf_dir, "documents").withColumn("source", F.coalesce("source", F.lit("-")))
    by = docs.groupBy("source").agg(F.min("doc_id").alias("seq"), F.collect_set("lang").alias("langs"), F.max(F.floor(F.col("n_chars") / 10000)).cast("int").alias("size"))
    queries = F.transform(F.col("langs"), lambda x: F.struct(F.concat(F.col("source"), F.lit(":"), x).alias("id"), x.alias("label"), x.alias("query"), F.col("size").alias("candidate_limit")))
    return by.select(
        "seq", F.col("source").alias("strategy_id"), F.array(F.lit("openalex")).alias("providers"), queries.alias("search_queries"), F.lit(None).cast(f"array<{retrieval.FEED}>").alias("arxiv_search_queries"),
        F.lit("topic").alias("primary_filter"), F.lit(None).cast("array<string>").alias("arxiv_categories"), F.lit("2020-01-01").alias("from_date"), F.lit(None).cast("string").alias("to_date"),
    )


STRATEGIES = """s AS (SELECT coalesce(source, '-') AS strategy_id, min(doc_id) AS seq, list_sort(list(DISTINCT lang) FILTER (lang IS NOT NULL)) AS langs, max(n_chars // 10000) AS size FROM documents GROUP BY ALL),
p AS (SELECT seq, strategy_id, left(sha256('{"arxiv_categories":null,"arxiv_search_queries":[],"openalex_primary_filter":"topic","providers":["openalex"],"publication_from_date":"2020-01-01","publication_to_date":null,"search_queries":[' ||
  array_to_string(list_transform(langs, lambda l: '{"candidate_limit":' || size || ',"query":"' || l || '"}'), ',') || ']}'), 24) AS fingerprint FROM s),
f AS (SELECT fingerprint, min(seq) AS seq FROM p GROUP BY fingerprint ORDER BY seq LIMIT 3), n AS (SELECT seq, row_number() OVER (ORDER BY seq) AS number FROM f),
a AS (SELECT p.seq, strategy_id, fingerprint, number::INT AS number, CASE WHEN number IS NOT NULL THEN 'taken' WHEN (SELECT count(*) FROM n) = 3 AND p.seq > (SELECT max(seq) FROM n) THEN 'too many' ELSE 'duplicate' END AS outcome FROM p LEFT JOIN n USING (seq))"""


def judged(spark, sf_dir) -> DataFrame:
    own = strategies(spark, sf_dir).withColumn("fingerprint", retrieval.fingerprint())
    return written(own.select("seq", "strategy_id", "fingerprint").join(retrieval.attempts(own).drop("fingerprint"), "seq"), "attempts")


@query(f"WITH {STRATEGIES} SELECT seq, strategy_id, fingerprint, number, outcome FROM a")
def retrieval_attempts(spark, sf_dir):
    """The outcome of each source's strategy: the first three that ask for different things are taken."""
    return judged(spark, sf_dir)


KEY = f"trim(regexp_replace(lower({TITLE}), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""WITH {STRATEGIES}, c AS (SELECT {KEY} AS identity, number, doc_id, {TITLE} AS title FROM documents JOIN a ON strategy_id = coalesce(source, '-') WHERE number IS NOT NULL),
g AS (SELECT identity, min((number, doc_id, title)) AS f, array_to_string(list_sort(list(DISTINCT number)), ',') AS hits FROM c WHERE identity <> '' GROUP BY identity)
SELECT identity, f[1]::INT AS attempt, f[2]::INT AS at, f[3] AS title, hits FROM g""")
def accumulated_candidates(spark, sf_dir):
    """Titles of the three attempts, merged one attempt after another into committed versions."""
    taken = judged(spark, sf_dir).where("number is not null").orderBy("number").collect()  # three
    store = Snapshots(spark, new_path(spark, "retrieval"), retrieval.FOUND, "identity")
    docs = table(spark, sf_dir, "documents").withColumn("title", F.element_at(F.split("text", "\\n"), 1))
    for t in taken:
        own = docs.where(F.coalesce("source", F.lit("-")) == t["strategy_id"])
        retrieval.accumulate(store, own.select(text.title_key(F.col("title")).alias("identity"), F.col("doc_id").cast("int").alias("at"), "title"), t["number"])
    return store.read().select("identity", "attempt", "at", "title", F.array_join(F.transform("hits", lambda h: h.cast("string")), ",").alias("hits"))


#: Words of the vocabulary in each document of a label, with the document's title as paper; what lacks a title or a language is incomplete.
PAPER_WORDS = f"""{VOCAB}, own AS (SELECT doc_id, lemma, n FROM counts JOIN labels USING (doc_id) WHERE lemma IN (SELECT lemma FROM vocab)),
w AS (SELECT doc_id, lemma, n, quality, trim(lower(coalesce(lang, ''))) AS sense, {TITLE} AS title, source FROM own JOIN documents USING (doc_id) JOIN labels USING (doc_id))"""


def paper_words(spark, sf_dir):
    """Words of labelled documents: their sense is the document's language, their meaning its source; good documents are papers."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    labelled = documents(spark, sf_dir).join(labels.select("doc_id"), "doc_id", "left_semi")
    own = lx.lemma_counts(lx.tokens(labelled)).join(vocab(spark, sf_dir).select("lemma"), "lemma", "left_semi")
    title = F.element_at(F.split("text", "\\n"), 1)
    words = own.join(docs.select("doc_id", "lang", "source", title.alias("_title")), "doc_id").select(
        F.col("doc_id").alias("paper_id"), "lemma", F.lit("NOUN").alias("part_of_speech"), F.col("source").alias("meaning_zh"), F.lit("").alias("meaning_en"), F.col("_title").alias("context"), text.stable_id(F.col("doc_id").cast("string"), length=24).alias("evidence_context_id"), F.col("lang").alias("sense_key"), "n"
    )
    shown = labels.where("quality = 1").select("doc_id").join(docs, "doc_id").select(F.col("doc_id").alias("paper_id"), title.alias("title"), F.concat(F.lit("https://x/"), "doc_id").alias("source_url"))
    return words, shown


@query(f"""WITH {PAPER_WORDS} SELECT doc_id AS paper_id, CASE WHEN coalesce(quality, 0) <> 1 THEN 'no such paper' WHEN trim(coalesce(source, '')) = '' THEN 'no meaning' WHEN trim(coalesce(title, '')) = '' THEN 'no context' WHEN sense = '' THEN 'no sense' ELSE 'complete' END AS outcome, count(*) AS words FROM w GROUP BY ALL""")
def paper_vocabulary(spark, sf_dir):
    """Words of each labelled document as its page shows them, and those that are incomplete, by why."""
    words, shown = paper_words(spark, sf_dir)
    every = papers.judged_words(words, shown).select("paper_id", F.coalesce("violation", F.lit("complete")).alias("outcome"))
    return every.groupBy("paper_id", "outcome").agg(F.count(F.lit(1)).alias("words"))


@query(f"""WITH {TERMS}, b AS (SELECT lower(text) AS t FROM benchmark), l AS (SELECT term, EXISTS (SELECT 1 FROM b WHERE contains(t, term)) AS in_latest FROM terms)
SELECT term, total_count, document_count, in_latest, row_number() OVER (ORDER BY in_latest DESC, document_count DESC, total_count DESC, term) AS place FROM terms JOIN l USING (term)""")
def term_list(spark, sf_dir):
    """All terms as they are listed: those that stand in the benchmark's items first."""
    own = written(terms(spark, sf_dir).select("term", "total_count", "document_count"), "terms")
    items = table(spark, sf_dir, "benchmark").select(F.lower("text").alias("t"))
    latest = search.containing(own, "term", items, "t").select("term")
    return papers.term_list(own, latest).select("term", "total_count", "document_count", "in_latest", "place")
