"""Queries of validators, over decisions and records made of the tables by fixed rules that break each of theirs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import validation as v
from quillspark.plans.base import query, table


def s(c):
    return c.cast("string")


def tagged(prefix: str, c):
    return F.concat(F.lit(prefix), s(c))


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN 'schema version' ELSE 'reviewer' END AS violation FROM supplier WHERE s_suppkey % 5 = 0 OR s_suppkey % 7 = 0""")
def review_identity_violations(spark, sf_dir):
    k = F.col("s_suppkey")
    return v.review_identity(table(spark, sf_dir, "supplier").select(k.alias("id"), F.when(k % 5 == 0, 2).otherwise(1).alias("schema_version"), F.when(k % 7 == 0, "x").otherwise(v.REVIEWER).alias("reviewer")))


@query("""WITH sel AS (SELECT 'c' || (user_id % 90) AS candidate_id FROM events WHERE event_type = 'purchase'), n AS (SELECT candidate_id, count(*) AS n FROM sel GROUP BY 1),
k AS (SELECT *, substr(candidate_id, 2)::INT AS i FROM n) SELECT candidate_id, CASE WHEN n > 1 THEN 'repeated' WHEN i % 3 = 0 THEN 'outside the packet' ELSE 'unknown' END AS violation FROM k WHERE n > 1 OR i % 3 = 0 OR i > 60""")
def selection_violations(spark, sf_dir):
    own = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(tagged("c", F.col("user_id") % 90).alias("candidate_id"))
    ids = spark.range(0, 90).select(F.col("id"), tagged("c", F.col("id")).alias("candidate_id"))
    return v.selection(own, ids.where("id % 3 <> 0"), ids.where("id <= 60"))


@query("""WITH c AS (SELECT 'w' || p_partkey AS lemma, p_partkey AS k FROM part), d AS (SELECT lemma, NULL AS target, k FROM c WHERE k % 3 = 0 UNION ALL SELECT lemma, CASE WHEN k % 7 = 0 THEN 'x9' ELSE 'target' END, k FROM c WHERE k % 3 = 1 UNION ALL SELECT lemma, NULL, k FROM c WHERE k % 5 = 0 UNION ALL SELECT 'z' || k, NULL, k FROM c WHERE k % 50 = 0),
p AS (SELECT lemma, count(*) AS n, max(target) AS target FROM d GROUP BY 1)
SELECT * FROM (SELECT coalesce(c.lemma, p.lemma) AS lemma, CASE WHEN c.lemma IS NULL THEN 'unknown' WHEN n IS NULL THEN 'undecided' WHEN n > 1 THEN 'decided more than once' WHEN target = 'x9' THEN 'target is no word' END AS violation FROM c FULL JOIN p ON c.lemma = p.lemma) WHERE violation IS NOT NULL""")
def orthography_violations(spark, sf_dir):
    k = F.col("p_partkey")
    c = table(spark, sf_dir, "part").select(k, tagged("w", k).alias("lemma"))
    keeps = c.where(k % 3 == 0).select("lemma").union(c.where(k % 50 == 0).select(tagged("z", k)))
    return v.orthography(c, keeps, c.where(k % 3 == 1).select("lemma", F.when(k % 7 == 0, "x9").otherwise("target").alias("target")), c.where(k % 5 == 0).select("lemma"))


@query("""WITH t AS (SELECT s_suppkey AS id, 10 + s_suppkey % 3 AS r, 5 AS a, CASE WHEN s_suppkey % 11 = 0 THEN -1 ELSE 2 END AS b, 3 AS c FROM supplier) SELECT id, CASE WHEN b < 0 THEN 'no count' ELSE 'does not add up' END AS violation FROM t WHERE b < 0 OR r <> a + b + c""")
def orthography_summary_violations(spark, sf_dir):
    k = F.col("s_suppkey")
    own = table(spark, sf_dir, "supplier").select(k.alias("id"), (10 + k % 3).alias("reviewed_candidate_count"), F.lit(5).alias("replacement_count"), F.when(k % 11 == 0, -1).otherwise(2).alias("drop_count"), F.lit(3).alias("explicit_keep_count"), F.lit(3).alias("unchanged_candidate_count"))
    return v.orthography_summary(own)


@query("""WITH t AS (SELECT p_partkey AS k, 't' || p_partkey AS term FROM part), sel AS (SELECT k, CASE WHEN k % 40 = 0 THEN 'q' || k ELSE term END AS term, CASE WHEN k % 13 = 0 THEN 1.5 ELSE 0.5 END AS confidence FROM t WHERE k % 2 = 0),
ex AS (SELECT k, term, k % 17 = 0 AS short FROM t WHERE k % 9 <> 0 AND (k % 2 = 0 OR k % 25 = 0)), ev AS (SELECT term FROM t WHERE k % 6 <> 0 AND k % 10 <> 3)
SELECT * FROM (SELECT coalesce(sel.term, ex.term) AS term, CASE WHEN sel.term IS NULL THEN 'explained but not selected' WHEN sel.k % 40 = 0 THEN 'unknown' WHEN confidence > 1 THEN 'confidence' WHEN ex.term IS NULL THEN 'no explanation' WHEN short THEN 'incomplete explanation' WHEN sel.term NOT IN (SELECT term FROM ev) THEN 'no evidence' END AS violation
FROM sel FULL JOIN ex ON sel.term = ex.term) WHERE violation IS NOT NULL""")
def terminology_violations(spark, sf_dir):
    k = F.col("p_partkey")
    t = table(spark, sf_dir, "part").select(k.alias("k"), tagged("t", k).alias("term"))
    k = F.col("k")
    chosen = t.where(k % 2 == 0).select(F.when(k % 40 == 0, tagged("q", k)).otherwise(F.col("term")).alias("term"), F.when(k % 13 == 0, 1.5).otherwise(0.5).alias("confidence"))
    example = F.array(F.struct(F.when(k % 6 == 0, "P8").otherwise("P1").alias("paper_id"), F.when(k % 10 == 3, " ").otherwise("said").alias("sentence")))
    candidates = t.select("term", F.array(F.lit("P1"), F.lit("P2")).alias("source_papers"), example.alias("examples"))
    told = t.where((k % 9 != 0) & ((k % 2 == 0) | (k % 25 == 0))).select("term", F.lit("en").alias("meaning_en"), F.when(k % 17 == 0, " ").otherwise("zh").alias("meaning_zh"), F.lit("role").alias("concept_role"), F.lit("key").alias("sense_key"))
    return v.terminology(chosen, candidates, told, spark.sql("SELECT 'P1' AS paper_id UNION ALL SELECT 'P2'"))


# Brief items of conversations; each rule is broken by some.
ITEMS = """items AS (SELECT conv_id, turn, 'b' || CASE WHEN conv_id % 19 = 0 THEN '/' ELSE '' END || conv_id AS brief_id, CASE WHEN conv_id % 11 = 0 THEN 'same' ELSE 'i' || conv_id || '-' || turn END AS item_id, CASE WHEN conv_id % 7 = 0 THEN ' ' ELSE 'title' END AS title, CASE WHEN turn % 5 = 3 THEN 'ftp://x' ELSE 'https://x.org/' || turn END AS source_url,
  CASE WHEN turn = 1 AND conv_id % 3 = 0 THEN 'other' ELSE 'new_paper' END AS item_type, CASE WHEN conv_id % 4 = 0 THEN ' ' ELSE 'ctx' END AS context, CASE WHEN conv_id % 6 = 0 THEN '' ELSE 'e' END AS evidence FROM conversations)"""


def brief_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    word = F.struct(F.lit("w").alias("lemma"), F.when(c % 4 == 0, " ").otherwise("ctx").alias("context"), F.when(c % 6 == 0, "").otherwise("e").alias("evidence_context_id"))
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("b"), F.when(c % 19 == 0, "/").otherwise(""), s(c)).alias("brief_id"), F.when(c % 11 == 0, "same").otherwise(F.concat(F.lit("i"), s(c), F.lit("-"), s(t))).alias("item_id"), F.when(c % 7 == 0, " ").otherwise("title").alias("title"),
        F.when(t % 5 == 3, "ftp://x").otherwise(F.concat(F.lit("https://x.org/"), s(t))).alias("source_url"), F.lit("why").alias("value_reason"), F.lit("see").alias("shadow_preview"), F.when((t == 1) & (c % 3 == 0), "other").otherwise("new_paper").alias("item_type"), F.array(word).alias("vocabulary"),
    )


@query(f"""WITH {ITEMS}, n AS (SELECT brief_id, count(*) AS n FROM items GROUP BY 1), m AS (SELECT brief_id, item_id, count(*) AS m FROM items GROUP BY ALL), j AS (SELECT * FROM items JOIN n USING (brief_id) JOIN m USING (brief_id, item_id))
SELECT DISTINCT brief_id, item_id, violation FROM (SELECT brief_id, item_id, unnest(list_filter([CASE WHEN n NOT BETWEEN 2 AND 5 THEN 'number of items' END, CASE WHEN contains(brief_id, '/') THEN 'unsafe brief id' END, CASE WHEN trim(title) = '' THEN 'missing text' END, CASE WHEN m > 1 THEN 'repeated item' END,
  CASE WHEN starts_with(source_url, 'ftp') THEN 'url' END, CASE WHEN item_type = 'other' THEN 'item type' END, CASE WHEN trim(context) = '' THEN 'word without context' END, CASE WHEN evidence = '' THEN 'word without evidence' END], lambda x: x IS NOT NULL)) AS violation FROM j)""")
def brief_shape_violations(spark, sf_dir):
    return v.briefs(brief_items(spark, sf_dir))


@query("""WITH a AS (SELECT o_orderkey AS k, 'i' || o_orderkey AS item_id FROM orders) SELECT item_id, unnest(CASE WHEN k % 9 = 0 THEN ['not prepared'] WHEN k % 7 = 0 THEN ['missing'] ELSE list_filter([CASE WHEN k % 5 = 0 THEN 'changed title' END, CASE WHEN k % 11 = 0 THEN 'changed item_type' END, CASE WHEN k % 4 = 0 THEN 'word not grounded' END, CASE WHEN k % 4 = 1 THEN 'changed context' END], lambda x: x IS NOT NULL) END) AS violation FROM a WHERE NOT (k % 9 = 0 AND k % 7 = 0)""")
def brief_provenance_violations(spark, sf_dir):
    k = F.col("o_orderkey")
    word = lambda lemma, context: F.array(F.struct(lemma.alias("lemma"), context.alias("context")))
    o = table(spark, sf_dir, "orders").select(k, tagged("i", k).alias("item_id"), F.lit("t").alias("title"), F.lit("https://x").alias("source_url"), F.lit("new_paper").alias("item_type"))
    prepared = o.where(k % 9 != 0).select("item_id", "title", "source_url", "item_type", word(F.lit("w"), F.lit("c ")).alias("vocabulary"))
    made = o.where(k % 7 != 0).select("item_id", F.when(k % 5 == 0, "T").otherwise(F.col("title")).alias("title"), "source_url", F.when(k % 11 == 0, "x").otherwise(F.col("item_type")).alias("item_type"), word(F.when(k % 4 == 0, "v").otherwise("W "), F.when(k % 4 == 1, "d").otherwise(" c")).alias("vocabulary"))
    return v.provenance(made, prepared)


@query("""WITH t AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 6 = 0 THEN 'paper' ELSE 'public_report' END AS item_type, CASE WHEN c_custkey % 8 = 0 THEN ' ' ELSE c_name END AS title, CASE WHEN c_custkey % 10 = 0 THEN 'ftp://a' ELSE 'https://A.org/' || (c_custkey % 100) || '/' END AS url, CASE WHEN c_custkey % 9 = 0 THEN 'soon' ELSE '2024-01-02' END AS day FROM customer),
n AS (SELECT *, row_number() OVER (PARTITION BY lower(rtrim(url, '/')) ORDER BY id) AS nth FROM t)
SELECT * FROM (SELECT id, CASE WHEN item_type = 'paper' THEN 'item type' WHEN trim(title) = '' THEN 'missing text' WHEN starts_with(url, 'ftp') THEN 'url' WHEN day = 'soon' THEN 'date' WHEN nth > 1 THEN 'repeated url' END AS violation FROM n) WHERE violation IS NOT NULL""")
def supplemental_violations(spark, sf_dir):
    k = F.col("c_custkey")
    own = table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 6 == 0, "paper").otherwise("public_report").alias("item_type"), F.when(k % 8 == 0, " ").otherwise(F.col("c_name")).alias("title"), F.when(k % 10 == 0, "ftp://a").otherwise(F.concat(F.lit("https://A.org/"), s(k % 100), F.lit("/"))).alias("source_url"), F.lit("").alias("content_url"), F.when(k % 9 == 0, "soon").otherwise("2024-01-02").alias("publication_date"), F.lit("v").alias("venue"))
    return v.supplemental(own)


@query("""WITH w AS (SELECT 'w' || CASE WHEN p_partkey % 31 = 0 THEN 1 ELSE p_partkey END AS lemma, CASE WHEN p_partkey % 12 = 0 THEN ' ' ELSE 'NOUN' END AS pos, p_size AS total, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE 1 END AS docs, CASE WHEN p_partkey % 9 = 0 THEN 0.0 ELSE 0.5 END AS share, CASE WHEN p_partkey % 10 = 0 THEN 9.0 ELSE 4.0 END AS zipf, CASE WHEN p_partkey % 8 = 0 THEN 'C1' END AS level, CASE WHEN p_partkey % 13 = 0 THEN 'x' ELSE 'gk' END AS tag FROM part),
n AS (SELECT lemma, count(*) AS n FROM w GROUP BY 1)
SELECT lemma, violation FROM (SELECT lemma, CASE WHEN n > 1 THEN 'repeated lemma' WHEN trim(pos) = '' THEN 'part of speech' WHEN docs > total OR total < 1 THEN 'count' WHEN share = 0 THEN 'share' WHEN zipf > 8 THEN 'zipf' WHEN level IS NOT NULL THEN 'level' WHEN tag = 'x' THEN 'tag' END AS violation FROM w JOIN n USING (lemma)) WHERE violation IS NOT NULL
UNION ALL SELECT NULL, 'number of words' FROM (SELECT count(*) AS n FROM part) WHERE n NOT BETWEEN 30 AND 10000""")
def word_statistics_violations(spark, sf_dir):
    k = F.col("p_partkey")
    own = table(spark, sf_dir, "part").select(tagged("w", F.when(k % 31 == 0, 1).otherwise(k)).alias("lemma"), F.when(k % 12 == 0, " ").otherwise("NOUN").alias("part_of_speech"), F.col("p_size").alias("total_count"), F.when(k % 7 == 0, F.col("p_size") + 1).otherwise(1).alias("document_count"), F.when(k % 9 == 0, 0.0).otherwise(0.5).alias("document_share"), F.when(k % 10 == 0, 9.0).otherwise(4.0).alias("zipf"), F.when(k % 8 == 0, "C1").alias("cefr_level"), F.array(F.when(k % 13 == 0, "x").otherwise("gk")).alias("exam_tags"))
    return v.word_statistics(own)


@query("""WITH t AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'weekly_brief' WHEN n_nationkey % 7 = 1 THEN 'monthly' ELSE 'daily_review' END AS section, CASE WHEN n_nationkey % 5 = 0 THEN '25:00' ELSE '09:30' END AS time, n_nationkey % 9 AS weekday FROM nation)
SELECT * FROM (SELECT *, CASE WHEN section = 'monthly' THEN 'section' WHEN time = '25:00' THEN 'time' WHEN section = 'weekly_brief' AND weekday NOT BETWEEN 1 AND 7 THEN 'weekday' END AS violation FROM t) WHERE violation IS NOT NULL""")
def settings_violations(spark, sf_dir):
    k = F.col("n_nationkey")
    return v.settings(table(spark, sf_dir, "nation").select(k.alias("id"), F.when(k % 2 == 0, "weekly_brief").when(k % 7 == 1, "monthly").otherwise("daily_review").alias("section"), F.when(k % 5 == 0, "25:00").otherwise("09:30").alias("time"), (k % 9).alias("weekday")))


@query("""WITH f AS (SELECT DISTINCT regexp_replace(p_type, '[^A-Za-z0-9._-]+', '_', 'g') AS file, p_type AS c FROM part UNION SELECT regexp_replace(p_type || '!', '[^A-Za-z0-9._-]+', '_', 'g'), p_type || '!' FROM part UNION SELECT regexp_replace(p_type || '?', '[^A-Za-z0-9._-]+', '_', 'g'), p_type || '?' FROM part)
SELECT file, count(*) AS candidates, min(c) AS first_id FROM f GROUP BY file HAVING count(*) > 1""")
def shared_file_names(spark, sf_dir):
    own = table(spark, sf_dir, "part").select(F.explode(F.array("p_type", F.concat("p_type", F.lit("!")), F.concat("p_type", F.lit("?")))).alias("candidate_id"))
    return v.file_names(own)


@query("""WITH t AS (SELECT user_id % 40 AS selection_id, 'c' || (event_id % 30) AS candidate_id, ['k' || (event_id % 45), 'j' || event_id] AS keys FROM events WHERE event_id % 50 = 0),
a AS (SELECT selection_id, count(*) AS n, count(DISTINCT candidate_id) AS ids FROM t GROUP BY 1), b AS (SELECT selection_id, max(k) AS most FROM (SELECT selection_id, key, count(DISTINCT candidate_id) AS k FROM (SELECT selection_id, candidate_id, unnest(keys) AS key FROM t) GROUP BY ALL) GROUP BY 1)
SELECT selection_id, unnest(list_filter([CASE WHEN n NOT BETWEEN 2 AND 5 THEN 'number of items' END, CASE WHEN ids < n THEN 'repeated id' END, CASE WHEN most > 1 THEN 'one source twice' END], lambda x: x IS NOT NULL)) AS violation FROM a JOIN b USING (selection_id)""")
def prepared_selection_violations(spark, sf_dir):
    e = F.col("event_id")
    own = table(spark, sf_dir, "events").where("event_id % 50 = 0").select((F.col("user_id") % 40).alias("selection_id"), tagged("c", e % 30).alias("candidate_id"), F.array(tagged("k", e % 45), tagged("j", e)).alias("keys"))
    return v.prepared_selection(own)


@query("""WITH t AS (SELECT s_suppkey AS k, 's' || s_suppkey AS profile_id FROM supplier)
SELECT profile_id, unnest(list_filter([CASE WHEN k % 5 = 0 THEN 'version' END, CASE WHEN k % 7 = 0 THEN 'not confirmed' END, CASE WHEN k % 2 = 1 THEN 'missing text' END, CASE WHEN k % 6 NOT IN (3, 4) THEN 'number of clarifications' END, CASE WHEN k % 4 = 0 AND k % 6 > 0 THEN 'empty clarification' END, CASE WHEN k % 8 < 3 THEN 'number of queries' END,
  CASE WHEN k % 9 = 0 AND k % 8 >= 2 THEN 'repeated query' END, CASE WHEN k % 10 = 0 AND k % 8 > 0 THEN 'candidate limit' END, CASE WHEN k % 3 = 0 THEN 'providers' END], lambda x: x IS NOT NULL)) AS violation FROM t""")
def profile_violations(spark, sf_dir):
    k = F.col("s_suppkey").cast("int")
    up_to = lambda n: F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    told = F.transform(up_to(k % 6), lambda i: F.struct(F.lit("q").alias("question"), F.when(k % 4 == 0, "").otherwise("a").alias("answer")))
    asked = F.transform(up_to(k % 8), lambda i: F.struct(F.when(k % 9 == 0, "same").otherwise(s(i)).alias("id"), F.lit("l").alias("label"), F.lit("q").alias("query"), F.when(k % 10 == 0, 70).otherwise(F.lit(None)).cast("int").alias("candidate_limit")))
    providers = F.when(k % 3 == 0, F.array(F.lit("arxiv"), F.lit("arxiv"))).otherwise(F.array(F.lit("openalex"), F.lit("arxiv")))
    own = table(spark, sf_dir, "supplier").select(tagged("s", k).alias("profile_id"), F.when(k % 5 == 0, 2).otherwise(1).alias("version"), (k % 7 != 0).alias("confirmed"), F.lit("u").alias("user_statement"), F.when(k % 2 == 1, "").otherwise("r").alias("research_summary"), told.alias("clarifications"), asked.alias("search_queries"), providers.alias("providers"))
    return v.profiles(own)


@query("""WITH p AS (SELECT 'w' || p_partkey AS lemma, p_partkey // 40 AS batch, p_partkey AS k FROM part), r AS (SELECT lemma, batch FROM p WHERE k % 6 <> 0 UNION ALL SELECT lemma, batch + 1 FROM p WHERE k % 9 = 0 UNION ALL SELECT 'x' || k, batch FROM p WHERE k % 70 = 0),
d AS (SELECT lemma, count(*) AS n, min(batch) AS b FROM r GROUP BY 1)
SELECT * FROM (SELECT coalesce(p.lemma, d.lemma) AS lemma, CASE WHEN batch IS NULL THEN 'unknown' WHEN n IS NULL THEN 'undecided' WHEN n > 1 THEN 'decided more than once' WHEN b <> batch THEN 'decided in another batch' END AS violation FROM p FULL JOIN d ON p.lemma = d.lemma) WHERE violation IS NOT NULL""")
def review_batch_violations(spark, sf_dir):
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(k, tagged("w", k).alias("lemma"), F.floor(k / 40).alias("batch"))
    done = p.where(k % 6 != 0).select("lemma", "batch").union(p.where(k % 9 == 0).select("lemma", F.col("batch") + 1)).union(p.where(k % 70 == 0).select(tagged("x", k), "batch"))
    return v.batches(p.select("lemma", "batch"), done)


@query("""WITH r AS (SELECT 'd' || (n_nationkey % 22) AS domain_id, '/w' || (n_nationkey % 23) AS workspace FROM nation)
SELECT domain_id, 'repeated id' AS violation FROM r GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT min(domain_id), 'repeated workspace' FROM r GROUP BY workspace HAVING count(*) > 1 UNION ALL SELECT NULL, 'not one active domain'""")
def registry_violations(spark, sf_dir):
    k = F.col("n_nationkey")
    return v.registry(table(spark, sf_dir, "nation").select(tagged("d", k % 22).alias("domain_id"), tagged("/w", k % 23).alias("workspace"), (k % 10 == 0).alias("active")))
