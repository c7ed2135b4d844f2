"""Queries of briefs, cards and timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import briefs, learning, lexicon
from quillspark.plans import learner
from quillspark.plans.base import query, table


@query("""WITH p AS (SELECT p_partkey AS k, p_brand AS lemma, CASE p_size % 3 WHEN 0 THEN 'n' WHEN 1 THEN 'v' ELSE 'a' END AS pos FROM part),
cards AS (SELECT lemma, pos, 'c' || min(k) AS card_id FROM p WHERE k % 5 < 2 GROUP BY ALL), one AS (SELECT lemma, min(card_id) AS only_id FROM cards GROUP BY lemma HAVING count(*) = 1)
SELECT k, coalesce(card_id, only_id) AS card_id FROM p LEFT JOIN cards USING (lemma, pos) LEFT JOIN one USING (lemma)""")
def card_fallback_join(spark, sf_dir):
    pos = F.element_at(F.array(F.lit("n"), F.lit("v"), F.lit("a")), F.col("p_size") % 3 + 1)
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("lemma"), pos.alias("part_of_speech"))
    cards = p.where("k % 5 < 2").groupBy("lemma", "part_of_speech").agg(F.concat(F.lit("c"), F.min("k").cast("string")).alias("card_id"))
    return briefs.with_fallback(p, cards).select("k", "card_id")


@query("""WITH w AS (SELECT conv_id, turn, unnest(l) AS form, generate_subscripts(l, 1) AS pos FROM (SELECT conv_id, turn, regexp_extract_all(text, '[A-Za-z][A-Za-z''-]*') AS l FROM conversations))
SELECT conv_id, lower(form) AS lemma, arg_min(form, (turn, pos)) AS form FROM w GROUP BY ALL""")
def brief_vocabulary_first(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    w = c.select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit("([A-Za-z][A-Za-z'-]*)"), F.lit(1))).alias("pos", "form"))
    w = w.withColumn("lemma", F.lower("form"))
    return briefs.first_per(w, ["conv_id", "lemma"], ["turn", "pos"]).select("conv_id", "lemma", "form")


@query("""WITH u AS (SELECT user_id AS id, 0 AS f, event_id AS o FROM events WHERE event_type = 'purchase' UNION ALL SELECT user_id, 1, event_id FROM events WHERE event_type = 'click')
SELECT id, row_number() OVER (ORDER BY a) AS position FROM (SELECT id, min((f, o)) AS a FROM u GROUP BY id)""")
def selection_union(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("o"), "event_type")
    return briefs.ordered_union("id", "o", e.where("event_type = 'purchase'"), e.where("event_type = 'click'"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 40")
def result_page(spark, sf_dir):
    return briefs.page(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), [F.desc("n_chars"), "doc_id"], 20, 3)


@query("""WITH sents AS (SELECT doc_id, unnest(s) AS raw, generate_subscripts(s, 1) - 1 AS sent FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM documents)),
said AS (SELECT doc_id, sent, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS sentence FROM sents),
held AS (SELECT doc_id, sent, sentence, lower(unnest(regexp_extract_all(sentence, '[A-Za-z][A-Za-z''-]*'))) AS lemma FROM said)
SELECT lemma, count(*) AS n, arg_min(sentence, (doc_id, sent)) AS context FROM held WHERE lemma IN (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) FROM benchmark) GROUP BY lemma ORDER BY n DESC, lemma LIMIT 80""")
def unfamiliar_words(spark, sf_dir):
    unknown = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("lemma"))
    return briefs.unfamiliar(table(spark, sf_dir, "documents"), unknown)


@query("""WITH i AS (SELECT conv_id AS brief_id, role || '-' || (turn // 2) AS item_id, CASE WHEN turn = 4 THEN 'ftp://x' ELSE 'https://h/' || turn END AS url FROM conversations),
b AS (SELECT brief_id, count(*) AS n, count(DISTINCT item_id) AS d, count(*) FILTER (NOT regexp_matches(item_id, '^[A-Za-z0-9][A-Za-z0-9._:-]*$')) AS bad_id, count(*) FILTER (NOT regexp_matches(url, '^https?://[^/]+')) AS bad_url FROM i GROUP BY brief_id)
SELECT * FROM (SELECT brief_id, CASE WHEN n NOT BETWEEN 2 AND 5 THEN 'number of items' WHEN d < n THEN 'repeated id' WHEN bad_id > 0 THEN 'unsafe id' WHEN bad_url > 0 THEN 'address' END AS violation FROM b) WHERE violation IS NOT NULL""")
def brief_audit(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    item = F.concat("role", F.lit("-"), F.floor(F.col("turn") / 2).cast("string"))
    url = F.when(F.col("turn") == 4, "ftp://x").otherwise(F.concat(F.lit("https://h/"), F.col("turn").cast("string")))
    return briefs.brief_violations(c.select(F.col("conv_id").alias("brief_id"), item.alias("item_id"), url.alias("url")))


@query("""WITH a AS (SELECT event_type AS phase, event_id % 9 AS attempt, epoch_us(ts) AS started, epoch_us(ts) + (event_id % 1000) * 1000 AS finished FROM events)
SELECT phase, max(attempt) AS attempts, round(sum(finished - started) / 1e6, 3) AS busy_seconds, round((max(finished) - min(started)) / 1e6, 3) AS wall_seconds FROM a GROUP BY phase""")
def timeline_rollup(spark, sf_dir):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, sf_dir, "events")
    return briefs.timeline(e.select(F.col("event_type").alias("phase"), (F.col("event_id") % 9).alias("attempt"), at.alias("started"), (at + F.col("event_id") % 1000 * 1000).alias("finished")))


@query(f"""WITH {learner.WORDS} SELECT max(floor(document_count / document_share + 0.5))::BIGINT AS corpus_size, count(cefr) AS with_level, count(*) FILTER (tag < 3) AS with_tag, bool_or(adj > 0) AS adjusted FROM en""")
def prior_provenance(spark, sf_dir):
    return briefs.provenance(learner.words(spark, sf_dir))


@query(f"""WITH {learner.EVENTS}, life AS (SELECT item_id, arg_max(CASE WHEN action = 'master' THEN 'mastered' ELSE 'learning' END, (tm, seq)) AS status FROM ev WHERE action IN ('start', 'master', 'restore') GROUP BY item_id)
SELECT item_id % 4 AS domain, count(*) FILTER (status = 'learning') AS learning, count(*) FILTER (status = 'mastered') AS mastered FROM life GROUP BY 1""")
def domain_counts(spark, sf_dir):
    life = learning.lifecycle(learner.events(spark, sf_dir))
    by = life.groupBy((F.col("item_id") % 4).alias("domain"))
    return by.agg(F.count_if(F.col("status") == "learning").alias("learning"), F.count_if(F.col("status") == "mastered").alias("mastered"))


@query("""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z''-]*')) AS form FROM documents), p AS (SELECT doc_id, lower(form) AS lemma, count(*) AS n FROM t WHERE length(form) >= 2 GROUP BY ALL)
SELECT doc_id, count(*) AS lemmas, sum(n)::BIGINT AS tokens FROM p GROUP BY doc_id""")
def document_profiles(spark, sf_dir):
    counts = lexicon.lemma_counts(lexicon.tokens(table(spark, sf_dir, "documents")))
    return counts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lemmas"), F.sum("n").alias("tokens"))
