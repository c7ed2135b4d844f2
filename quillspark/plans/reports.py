"""Reports over selection, discovery and briefs, and queries of annotated text."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import annotation, discovery, selection, store
from quillspark.plans import lexicon
from quillspark.plans import selection as chosen
from quillspark.plans import store as kept
from quillspark.plans.base import query, table

TAGGED = f"""raw AS (SELECT doc_id, unnest(t) AS form, generate_subscripts(t, 1) - 1 AS no FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z][A-Za-z'']*|[0-9]+|[^\\sA-Za-z0-9]') AS t FROM documents)),
tok AS (SELECT *, CASE WHEN regexp_matches(form, '^[0-9]+$') THEN 'NUM' WHEN NOT regexp_matches(form, '[A-Za-z0-9]') THEN 'PUNCT' WHEN regexp_matches(form, '(ing|ed)$') THEN 'VERB' WHEN regexp_matches(form, 'ly$') THEN 'ADV' WHEN regexp_matches(form, '(able|ible|ive|ous|al)$') THEN 'ADJ' ELSE 'NOUN' END AS pos,
  regexp_matches(form, '^[A-Za-z]+$') AS alpha, lower(form) IN ({lexicon.STOP_SQL}) AS stop FROM raw)"""


def tokens(spark, sf_dir):
    docs = lexicon.documents(spark, sf_dir)
    return docs.select("doc_id", F.posexplode(annotation.default_tokens(F.col("text"), lexicon.STOP)).alias("no", "token"))


@query(f"WITH {TAGGED} SELECT lower(form) AS lemma, pos AS part_of_speech, count(*) AS n, count(DISTINCT doc_id) AS documents FROM tok WHERE alpha AND NOT stop AND pos IN ('NOUN', 'VERB', 'ADJ', 'ADV') AND length(form) >= 2 GROUP BY ALL")
def content_word_counts(spark, sf_dir):
    own = annotation.content_words(tokens(spark, sf_dir))
    per = own.groupBy("doc_id", "lemma", "part_of_speech").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("lemma", "part_of_speech").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("documents"))


@query(f"""WITH {TAGGED}, w AS (SELECT doc_id, no, form, pos, alpha, stop, lead(form) OVER d AS f2, lead(pos) OVER d AS p2, lead(alpha) OVER d AS a2, lead(stop) OVER d AS s2, lead(form, 2) OVER d AS f3, lead(pos, 2) OVER d AS p3, lead(alpha, 2) OVER d AS a3, lead(stop, 2) OVER d AS s3 FROM tok WINDOW d AS (PARTITION BY doc_id ORDER BY no)),
c AS (SELECT doc_id, lower(form) AS x, lower(f2) AS y, lower(f3) AS z, NOT (stop OR pos = 'PUNCT') AS ex, NOT (s2 OR p2 = 'PUNCT') AS ey, NOT (s3 OR p3 = 'PUNCT') AS ez, alpha AND pos IN ('NOUN', 'ADJ') AS cx, a2 AND p2 IN ('NOUN', 'ADJ') AS cy, a3 AND p3 IN ('NOUN', 'ADJ') AS cz FROM w WHERE no % 3 = 0 AND f3 IS NOT NULL),
t AS (SELECT doc_id, CASE WHEN ex AND ez THEN CASE WHEN cx AND cz AND (cy OR y IN ('of', 'for', 'to', 'in', 'on', 'with', 'and') OR y = '-') THEN replace(x || ' ' || y || ' ' || z, ' - ', '-') END
  WHEN ex AND ey THEN CASE WHEN cx AND cy THEN x || ' ' || y END WHEN ey AND ez THEN CASE WHEN cy AND cz THEN y || ' ' || z END END AS term FROM c)
SELECT term, count(*) AS total_count, count(DISTINCT doc_id) AS document_count FROM t WHERE length(term) >= 5 GROUP BY term""")
def phrase_terms(spark, sf_dir):
    """Terms of phrases of three tokens, one after another."""
    docs = lexicon.documents(spark, sf_dir).select("doc_id", annotation.default_tokens(F.col("text"), lexicon.STOP).alias("t"))
    starts = F.filter(F.sequence(F.lit(1), F.size("t") - 2), lambda i: i % 3 == 1)
    phrases = docs.where("size(t) >= 3").select("doc_id", F.explode(F.transform(starts, lambda i: F.slice("t", i, F.lit(3)))).alias("tokens"))
    return annotation.phrase_terms(phrases)


@query(f"""WITH {chosen.RELEVANCE}, d AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'duplicate' ELSE 'include' END AS decision, len(regexp_extract_all(coalesce(text, ''), '\\S+')) AS words FROM documents),
pool AS (SELECT d.doc_id, relevance_score FROM d JOIN rel ON rel.id = d.doc_id WHERE decision = 'include' AND words >= 20), c AS (SELECT CASE WHEN count(*) >= 8 THEN least(0.22, quantile_cont(relevance_score, 0.10)) END AS cutoff FROM pool),
f AS (SELECT d.doc_id, CASE WHEN p.relevance_score < cutoff THEN 'low-relevance' ELSE decision END AS decision FROM d LEFT JOIN pool p USING (doc_id), c)
SELECT decision, count(*) AS n FROM f GROUP BY decision""")
def selection_decision_counts(spark, sf_dir):
    """Documents by decision: duplicates, and of the others with 20 words and a score those of low relevance."""
    k = F.when(F.col("doc_id") % 6 == 0, "duplicate").otherwise("include")
    d = table(spark, sf_dir, "documents").select("doc_id", k.alias("decision"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"\S+")).alias("words"))
    scored = chosen.relevance(spark, sf_dir).withColumnRenamed("id", "doc_id")
    pool = selection.relevance_decisions(d.where("decision = 'include' and words >= 20").join(scored, "doc_id").select(F.col("doc_id").alias("id"), "relevance_score"))
    low = pool.where("decision = 'low-relevance'").select(F.col("id").alias("doc_id"), F.lit(True).alias("_low"))
    decision = F.when(F.col("_low"), "low-relevance").otherwise(F.col("decision"))
    return d.join(low, "doc_id", "left").groupBy(decision.alias("decision")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT coalesce(source, '-') AS provider, count(*) AS candidates, count(*) FILTER (lang = 'en') AS downloaded, count(*) FILTER (lang = 'fr') AS failed, count(*) FILTER (lang IS NULL OR lang NOT IN ('en', 'fr')) AS skipped FROM documents GROUP BY ALL""")
def cold_start_summary(spark, sf_dir):
    status = F.when(F.col("lang") == "en", "downloaded").when(F.col("lang") == "fr", "failed").otherwise("skipped")
    d = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("-")).alias("provider"), status.alias("status"))
    return d.groupBy("provider").agg(F.count(F.lit(1)).alias("candidates"), *[F.count_if(F.col("status") == x).alias(x) for x in ("downloaded", "failed", "skipped")])


@query("""WITH t AS (SELECT DISTINCT p_brand AS term FROM part), s AS (SELECT DISTINCT 'Brand#' || (user_id % 30) AS term, CASE WHEN user_id % 2 = 0 THEN 'mastered' ELSE 'learning' END AS status FROM events), j AS (SELECT t.term, coalesce(max(s.status), 'new') AS status FROM t LEFT JOIN s USING (term) GROUP BY t.term)
SELECT count(*) AS all_terms, count(*) FILTER (status = 'new') AS new_terms, count(*) FILTER (status = 'learning') AS learning_terms, count(*) FILTER (status = 'mastered') AS mastered_terms FROM j""")
def term_status_counts(spark, sf_dir):
    u = F.col("user_id")
    s = table(spark, sf_dir, "events").select(F.concat(F.lit("Brand#"), (u % 30).cast("string")).alias("term"), F.when(u % 2 == 0, "mastered").otherwise("learning").alias("status"))
    t = table(spark, sf_dir, "part").select(F.col("p_brand").alias("term")).distinct().join(s.groupBy("term").agg(F.max("status").alias("status")), "term", "left")
    one = lambda x: F.count_if(F.coalesce("status", F.lit("new")) == x).alias(f"{x}_terms")
    return t.agg(F.count(F.lit(1)).alias("all_terms"), one("new"), one("learning"), one("mastered"))


@query("""WITH b AS (SELECT o_orderkey AS brief_id, o_orderdate AS period_end, o_custkey AS created_at, o_custkey % 50 AS paper FROM orders), t AS (SELECT p_partkey % 50 AS paper, count(*) AS n FROM part GROUP BY 1)
SELECT brief_id, coalesce(n, 0) AS estimated_terms FROM b LEFT JOIN t USING (paper) ORDER BY period_end DESC, created_at DESC, brief_id""")
def brief_list(spark, sf_dir):
    b = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("brief_id"), F.col("o_orderdate").alias("period_end"), F.col("o_custkey").alias("created_at"), (F.col("o_custkey") % 50).alias("paper"))
    t = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 50).alias("paper")).agg(F.count(F.lit(1)).alias("n"))
    return b.join(t, "paper", "left").orderBy(F.desc("period_end"), F.desc("created_at"), "brief_id").select("brief_id", F.coalesce("n", F.lit(0)).alias("estimated_terms"))


@query(f"""WITH {kept.DISC}, fresh AS (SELECT 'n' || doc_id AS identity, 'Title ' || (doc_id % 90) AS title, doc_id % 2 AS scope FROM documents), seen AS (SELECT DISTINCT 'title ' || trim(regexp_replace(lower(metadata::JSON->>'title'), '[^a-z0-9]+', ' ', 'g')) AS k FROM disc)
SELECT identity, true AS is_new FROM fresh WHERE scope = 1 AND 'title ' || lower(title) NOT IN (SELECT k FROM seen) UNION ALL SELECT identity, false FROM disc WHERE recommended_brief_id IS NULL AND metadata::JSON->>'discovery_scope_id' = 's1'""")
def discovery_increment(spark, sf_dir):
    """One run: candidates that no discovery has seen are recorded, and the whole pool of their scope comes back."""
    known = kept.discoveries(spark, sf_dir).drop("_changed")
    d = F.col("doc_id")
    own = table(spark, sf_dir, "documents").select(d.alias("seq"), F.concat(F.lit("n"), d.cast("string")).alias("identity"), F.concat(F.lit("Title "), (d % 90).cast("string")).alias("title"), F.concat(F.lit("s"), (d % 2).cast("string")).alias("discovery_scope_id"))
    none = F.lit(None).cast("string")
    keyed = own.select(F.col("identity").alias("id"), discovery.identity_keys(none, none, F.col("title"), F.col("identity"), none).alias("keys"))
    new = own.join(discovery.unseen(keyed, store.seen_keys(known)).select(F.col("id").alias("identity")), "identity", "left_semi")
    rows = new.select("seq", "identity", F.to_json(F.struct(F.col("identity").alias("candidate_id"), "title", "discovery_scope_id")).alias("metadata"))
    pool = store.pool(store.recorded(known, rows, F.lit("2024-01-03").cast("timestamp")).drop("_changed"), "s1")
    return pool.select("identity", F.col("identity").startswith("n").alias("is_new"))
