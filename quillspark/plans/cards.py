"""Queries of vocabulary cards and terms; cards and papers are made of parts and documents by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import cards
from quillspark.operators import lexicon as lx
from quillspark.plans import lexicon
from quillspark.plans.base import query, table
from quillspark.shared import written

EXPANDED = f"""{lexicon.ACRONYMS}, ex0 AS (SELECT DISTINCT lower(acronym) AS acronym, expansion FROM acr),
ex1 AS (SELECT *, regexp_extract(expansion, '([^ ]+)$', 1) AS tail, regexp_replace(expansion, '[^ ]+$', '') AS head FROM ex0),
ex2 AS (SELECT acronym, expansion, head || stem AS single FROM (SELECT *, unnest(list_filter([CASE WHEN tail LIKE '%ies' AND length(tail) > 3 THEN left(tail, -3) || 'y' END, CASE WHEN tail LIKE '%es' AND length(tail) > 2 THEN left(tail, -2) END,
  CASE WHEN tail LIKE '%s' AND length(tail) > 1 THEN left(tail, -1) END], lambda x: x IS NOT NULL)) AS stem FROM ex1)),
sets AS (SELECT acronym, list(expansion ORDER BY expansion) AS expansions FROM ex0 e WHERE NOT EXISTS (SELECT 1 FROM ex2 JOIN ex0 o ON ex2.acronym = o.acronym AND ex2.single = o.expansion WHERE ex2.acronym = e.acronym AND ex2.expansion = e.expansion) GROUP BY acronym)"""
SLUG = "CASE WHEN len(expansions) = 1 THEN trim(regexp_replace(lower(expansions[1]), '[^a-z0-9]+', '-', 'g'), '-') ELSE '' END"


def expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards.expansions(lx.acronyms(lexicon.marked(spark, sf_dir)))


@query(f"WITH {EXPANDED} SELECT acronym, array_to_string(expansions, '|') AS expansions, {SLUG} AS sense_key FROM sets")
def acronym_expansion_sets(spark, sf_dir):
    return expanded(spark, sf_dir).select("acronym", F.array_join("expansions", "|").alias("expansions"), cards.suggested_sense(F.col("expansions")).alias("sense_key"))


# Surface forms of lemmas, with those of one in five in capitals.
FORMS = f"""{lexicon.TOKENS}, shown AS (SELECT lemma, CASE WHEN length(lemma) % 5 = 0 THEN upper(form) || CASE WHEN pos % 3 = 0 THEN 's' ELSE '' END ELSE form END AS form, doc_id, pos FROM tokens),
forms AS (SELECT lemma, form, count(*) AS n FROM shown GROUP BY ALL), per AS (SELECT lemma, sum(n) AS seen, coalesce(sum(n) FILTER (regexp_matches(form, '^[A-Z][A-Z0-9-]{{1,11}}s?$')), 0) AS caps FROM forms GROUP BY lemma),
best AS (SELECT lemma, max((n, form)) FILTER (lower(form) = lemma) AS e, max((n, left(form, -1))) FILTER (form LIKE '%s' AND lower(left(form, -1)) = lemma) AS p FROM forms WHERE regexp_matches(form, '^[A-Z][A-Z0-9-]{{1,11}}s?$') GROUP BY lemma)"""


def word_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks = lx.tokens(lexicon.documents(spark, sf_dir))
    caps = F.concat(F.upper("form"), F.when(F.col("pos") % 3 == 0, "s").otherwise(""))
    forms = toks.select("lemma", F.when(F.length("lemma") % 5 == 0, caps).otherwise(F.col("form")).alias("form")).groupBy("lemma", "form").agg(F.count(F.lit(1)).alias("count"))
    return forms.groupBy("lemma").agg(F.collect_list(F.struct("form", "count")).alias("surface_forms"))


@query(f"""WITH {FORMS} SELECT lemma, CASE WHEN caps >= 2 AND caps * 2 >= seen OR length(lemma) % 7 = 0 THEN coalesce(coalesce(e, p)[2], lemma) ELSE lemma END AS display_form FROM per LEFT JOIN best USING (lemma)""")
def display_forms(spark, sf_dir):
    own = word_forms(spark, sf_dir)
    return own.select("lemma", cards.display_form(F.col("lemma"), F.col("surface_forms"), F.length("lemma") % 7 == 0).alias("display_form"))


REASONS = f"""{FORMS}, {lexicon.vocab_sql('(SELECT doc_id, lemma, count(*) AS n FROM tokens GROUP BY ALL)')},
w AS (SELECT lemma, CASE WHEN length(lemma) % 2 = 0 THEN 'NOUN' ELSE 'VERB' END AS part_of_speech, length(lemma) AS n FROM vocab),
dict AS (SELECT lemma, CASE WHEN n % 3 = 0 THEN 'n.' ELSE 'v' END AS pos, CASE WHEN n % 4 = 0 THEN 'abbr. of x' ELSE 'meaning' END AS en FROM w WHERE n % 6 <> 0 UNION ALL SELECT lemma, 'v', 'other' FROM w WHERE n % 5 = 0),
acro AS (SELECT lemma AS acronym, CASE WHEN n % 2 = 0 THEN ['a b', 'c d'] ELSE [lemma || ' Long-Name'] END AS expansions FROM w WHERE n % 8 = 0 OR n % 9 = 0),
j AS (SELECT w.lemma, part_of_speech, count(d.lemma) AS entries, count(*) FILTER (CASE part_of_speech WHEN 'NOUN' THEN contains(pos, 'n') ELSE contains(pos, 'v') END) AS fit, coalesce(bool_or(en LIKE '%abbr%'), false) AS short FROM w LEFT JOIN dict d ON w.lemma = d.lemma GROUP BY ALL),
r AS (SELECT j.lemma, part_of_speech, list_filter([CASE WHEN fit <> 1 AND entries <> 1 THEN 'no_unambiguous_dictionary_gloss' END, CASE WHEN entries > 1 THEN 'multiple_dictionary_entries' END, CASE WHEN caps >= 2 AND caps * 2 >= seen THEN 'acronym_surface_form' END,
  CASE WHEN acronym IS NOT NULL THEN 'corpus_acronym_expansion' END, CASE WHEN short THEN 'dictionary_abbreviation' END], lambda x: x IS NOT NULL) AS reasons, expansions FROM j JOIN per USING (lemma) LEFT JOIN acro ON j.lemma = acronym)"""


def reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("lemma")
    w = lexicon.vocab(spark, sf_dir).select("lemma", F.when(n % 2 == 0, "NOUN").otherwise("VERB").alias("part_of_speech"))
    w = written(w.join(word_forms(spark, sf_dir), "lemma"), "words")  # read four times below
    zh = F.lit("义").alias("meaning_zh")
    one = w.where(n % 6 != 0).select("lemma", F.when(n % 3 == 0, "n.").otherwise("v").alias("part_of_speech"), F.when(n % 4 == 0, "abbr. of x").otherwise("meaning").alias("meaning_en"), zh)
    two = w.where(n % 5 == 0).select("lemma", F.lit("v"), F.lit("other"), zh)
    long = F.array(F.concat("lemma", F.lit(" Long-Name")))
    acro = w.where((n % 8 == 0) | (n % 9 == 0)).select(F.col("lemma").alias("acronym"), F.when(n % 2 == 0, F.array(F.lit("a b"), F.lit("c d"))).otherwise(long).alias("expansions"))
    return cards.review_reasons(w, one.union(two), acro)


@query(f"WITH {REASONS} SELECT lemma, part_of_speech, array_to_string(reasons, ',') AS reasons, coalesce({SLUG}, '') AS suggested_sense_key FROM r")
def card_review_reasons(spark, sf_dir):
    return reasons(spark, sf_dir).select("lemma", "part_of_speech", F.array_join("reasons", ",").alias("reasons"), "suggested_sense_key")


@query(f"""WITH {REASONS}, s AS (SELECT lower(form) AS lemma, min((doc_id, pos)) AS f, count(*) AS n FROM tokens GROUP BY ALL)
SELECT lemma, part_of_speech, ceil(row_number() OVER (ORDER BY lemma, part_of_speech) / 40)::BIGINT AS batch, least(4, (SELECT count(*) FROM forms WHERE forms.lemma = r.lemma))::INT AS forms, least(2, n)::INT AS sentences FROM r JOIN s USING (lemma) WHERE len(reasons) > 0""")
def card_review_batches(spark, sf_dir):
    said = lx.tokens(lexicon.documents(spark, sf_dir)).select("lemma", F.col("pos").cast("int").alias("no"), F.col("doc_id").cast("string").alias("paper_id"), F.col("form").alias("sentence"))
    out = cards.review_batches(reasons(spark, sf_dir), said)
    return out.select("lemma", "part_of_speech", "batch", F.size("surface_forms").alias("forms"), F.size("sentences").alias("sentences"))


PAPERS = "papers AS (SELECT 'W' || s_suppkey AS paper_id, CASE WHEN s_suppkey % 4 = 0 THEN ' ' ELSE s_name END AS title, CASE WHEN s_suppkey % 8 = 0 THEN '' ELSE '/p/file.' || s_suppkey || '.pdf' END AS file, 'https://x.org/' || s_suppkey AS url FROM supplier WHERE s_suppkey % 5 <> 0)"


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = k.cast("string")
    return table(spark, sf_dir, "supplier").where("s_suppkey % 5 <> 0").select(F.concat(F.lit("W"), s).alias("paper_id"), F.when(k % 4 == 0, " ").otherwise(F.col("s_name")).alias("title"), F.when(k % 8 == 0, "").otherwise(F.concat(F.lit("/p/file."), s, F.lit(".pdf"))).alias("file"), F.concat(F.lit("https://x.org/"), s).alias("url"))


@query(f"""WITH {PAPERS}, e AS (SELECT doc_id % 300 AS key, doc_id AS no, 'W' || (doc_id % 40) AS paper_id, CASE WHEN doc_id % 9 = 0 THEN ' ' ELSE trim(split_part(text, chr(10), 1)) END AS sentence FROM documents),
j AS (SELECT key, no, paper_id, sentence, url, CASE WHEN trim(title) <> '' THEN trim(title) WHEN file <> '' THEN 'file.' || substr(paper_id, 2) ELSE 'Local paper' END AS source_title FROM e JOIN papers USING (paper_id) WHERE trim(coalesce(sentence, '')) <> '')
SELECT key, paper_id, source_title, url AS source_url, sentence AS context, left(sha256(paper_id || chr(31) || sentence), 24) AS evidence_context_id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY no) AS r FROM j) WHERE r = 1""")
def first_sources(spark, sf_dir):
    d = F.col("doc_id")
    first = F.trim(F.element_at(F.split("text", "\n"), 1))
    e = table(spark, sf_dir, "documents").select((d % 300).alias("key"), d.alias("no"), F.concat(F.lit("W"), (d % 40).cast("string")).alias("paper_id"), F.when(d % 9 == 0, " ").otherwise(first).alias("sentence"))
    out = cards.first_source(e, papers(spark, sf_dir))
    return out.withColumn("evidence_context_id", cards.evidence_id(F.col("paper_id"), F.col("context")))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'https://a.org' WHEN s_suppkey % 5 = 1 THEN 'https://doi.org/10.1/' || s_suppkey WHEN s_suppkey % 5 = 2 THEN 'https://arxiv.org/abs/24.' || s_suppkey
  WHEN s_suppkey % 5 = 3 THEN 'https://openalex.org/W' || s_suppkey ELSE '' END AS source_url, 'word:' || lower(s_name) || ':' || CASE WHEN s_suppkey % 2 = 0 THEN 'unknown' ELSE 'noun' END AS card_id FROM supplier""")
def source_urls(spark, sf_dir):
    k = F.col("s_suppkey")
    s, none = k.cast("string"), F.lit(None).cast("string")
    direct = F.when(k % 5 == 0, "https://a.org").otherwise("ftp://b")
    doi = F.when(k % 5 == 1, F.concat(F.lit("HTTPS://dx.doi.org/10.1/"), s))
    work = F.when(k % 5 == 3, F.concat(F.when(k % 2 == 0, "OpenAlex:W").otherwise("W"), s)).otherwise("x")
    url = cards.source_url(direct, doi, F.when(k % 5 == 2, F.concat(F.lit(" 24."), s)).otherwise(none), work)
    return table(spark, sf_dir, "supplier").select("s_suppkey", url.alias("source_url"), cards.card_id(F.col("s_name"), F.when(k % 2 == 0, " ").otherwise("Noun")).alias("card_id"))


# Cards of parts: several share a lemma, with one part of speech or another.
CARDS = "cards AS (SELECT 'c' || p_partkey AS card_id, 'k' || p_partkey AS sense_key, 'w' || (p_partkey % 150) AS lemma, CASE WHEN p_partkey % 300 < 150 THEN 'noun' ELSE 'verb' END AS part_of_speech, upper('w' || (p_partkey % 150)) AS display_form, p_name AS meaning_zh, p_type AS meaning_en, p_brand AS source_title, p_name || '. The W' || (p_partkey % 150) || ' of this paper is made of many parts. ' || p_type AS context FROM part WHERE p_partkey % 150 < 100 OR p_partkey < 150)"


def card_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    s = lambda c: c.cast("string")
    lemma = F.concat(F.lit("w"), s(k % 150))
    text = F.concat("p_name", F.lit(". The W"), s(k % 150), F.lit(" of this paper is made of many parts. "), "p_type")
    return table(spark, sf_dir, "part").where("p_partkey % 150 < 100 or p_partkey < 150").select(F.concat(F.lit("c"), s(k)).alias("card_id"), F.concat(F.lit("k"), s(k)).alias("sense_key"), lemma.alias("lemma"), F.when(k % 300 < 150, "noun").otherwise("verb").alias("part_of_speech"), F.upper(lemma).alias("display_form"), F.col("p_name").alias("meaning_zh"), F.col("p_type").alias("meaning_en"), F.col("p_brand").alias("source_title"), text.alias("context"))


@query(f"""WITH {CARDS}, c AS (SELECT lemma AS l, part_of_speech AS p, min(meaning_en) AS en, min(meaning_zh) AS zh, min(display_form) AS df, min(context) AS cx FROM cards GROUP BY ALL),
q AS (SELECT DISTINCT 'w' || (c_custkey % 200) AS lemma, CASE WHEN c_custkey % 2 = 0 THEN 'noun' ELSE 'verb' END AS part_of_speech FROM customer)
SELECT lemma, part_of_speech, df AS display_form, CASE WHEN length(en) > 140 THEN rtrim(left(en, 139)) || '…' ELSE en END AS meaning_en, CASE WHEN length(zh) > 140 THEN rtrim(left(zh, 139)) || '…' ELSE zh END AS meaning_zh,
  CASE WHEN l IS NOT NULL THEN 'The W' || substr(lemma, 2) || ' of this paper is made of many parts.' END AS example FROM q LEFT JOIN c ON lemma = l AND part_of_speech = p""")
def calibration_question_cards(spark, sf_dir):
    c = card_table(spark, sf_dir)
    c = c.groupBy("lemma", "part_of_speech").agg(*[F.min(x).alias(x) for x in ("display_form", "meaning_en", "meaning_zh", "context")])
    k = F.col("c_custkey")
    q = table(spark, sf_dir, "customer").select(F.concat(F.lit("w"), (k % 200).cast("string")).alias("lemma"), F.when(k % 2 == 0, "noun").otherwise("verb").alias("part_of_speech")).distinct()
    return cards.question_detail(q, c)


FALLBACK = f"""{CARDS}, one AS (SELECT lemma, part_of_speech, min(card_id) AS card_id FROM cards GROUP BY ALL), lone AS (SELECT lemma, count(*) AS n, min(card_id) AS card_id FROM one GROUP BY lemma),
rows AS (SELECT o_orderkey AS k, 'W' || (o_custkey % 160) AS lemma, CASE WHEN o_orderkey % 3 = 0 THEN 'noun' WHEN o_orderkey % 3 = 1 THEN 'verb' ELSE 'adj' END AS part_of_speech FROM orders),
found AS (SELECT rows.*, coalesce(e.card_id, CASE WHEN l.n = 1 THEN l.card_id END) AS card, coalesce(l.n, 0) AS cards FROM rows LEFT JOIN one e ON lower(rows.lemma) = e.lemma AND rows.part_of_speech = e.part_of_speech LEFT JOIN lone l ON lower(rows.lemma) = l.lemma)"""


def unique_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = card_table(spark, sf_dir)
    return c.groupBy("lemma", "part_of_speech").agg(F.min_by(F.struct(*[x for x in c.columns if x not in ("lemma", "part_of_speech")]), "card_id").alias("c")).select("lemma", "part_of_speech", "c.*")


def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    pos = F.when(k % 3 == 0, "noun").when(k % 3 == 1, "verb").otherwise("adj")
    return table(spark, sf_dir, "orders").select(k.alias("k"), F.concat(F.lit("W"), (F.col("o_custkey") % 160).cast("string")).alias("lemma"), pos.alias("part_of_speech"))


@query(f"WITH {FALLBACK} SELECT k, found.lemma, CASE WHEN card IS NULL THEN found.lemma ELSE display_form END AS display_form, meaning_en, meaning_zh FROM found LEFT JOIN cards c ON c.card_id = card")
def export_rows_with_cards(spark, sf_dir):
    out = cards.exported(export_rows(spark, sf_dir), unique_cards(spark, sf_dir))
    return out.select("k", "lemma", "display_form", "meaning_en", "meaning_zh")


BRIEF = f"""{FALLBACK}, b AS (SELECT k % 50 AS brief_id, k AS item_id, found.* EXCLUDE (k) FROM found)"""


def brief_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = export_rows(spark, sf_dir)
    word = F.struct("lemma", "part_of_speech", F.concat(F.lit("ctx "), F.col("k").cast("string")).alias("context"))
    return own.select((F.col("k") % 50).alias("brief_id"), F.col("k").alias("item_id"), F.array(word).alias("vocabulary"))


@query(f"WITH {BRIEF} SELECT brief_id, item_id, CASE WHEN card IS NULL THEN '' ELSE c.lemma || '/' || c.sense_key || '/ctx ' || item_id END AS words, (card IS NOT NULL)::INT AS estimated_unfamiliar_words FROM b LEFT JOIN cards c ON c.card_id = card")
def brief_canonical_vocabulary(spark, sf_dir):
    out = cards.canonical_vocabulary(brief_rows(spark, sf_dir), unique_cards(spark, sf_dir))[0]
    words = F.transform("vocabulary", lambda w: F.concat_ws("/", w["lemma"], w["sense_key"], w["context"]))
    return out.select("brief_id", "item_id", F.array_join(words, ",").alias("words"), "estimated_unfamiliar_words")


@query(f"WITH {BRIEF} SELECT brief_id, item_id, lemma, CASE WHEN cards = 0 THEN 'no such card' ELSE 'several cards' END AS violation FROM b WHERE card IS NULL")
def brief_vocabulary_violations(spark, sf_dir):
    return cards.canonical_vocabulary(brief_rows(spark, sf_dir), unique_cards(spark, sf_dir))[1]


@query(f"""WITH {CARDS}, bad AS (SELECT CASE WHEN substr(card_id, 2)::INT % 10 = 0 THEN 'c10' ELSE card_id END AS card_id, lemma, CASE WHEN substr(card_id, 2)::INT % 7 = 0 THEN ' ' ELSE meaning_zh END AS m, CASE WHEN substr(card_id, 2)::INT % 11 = 0 THEN 'other' ELSE display_form END AS df FROM cards),
n AS (SELECT card_id, count(*) AS n FROM bad GROUP BY 1)
SELECT card_id, lemma, CASE WHEN m = ' ' THEN 'incomplete' WHEN n > 1 THEN 'repeated id' ELSE 'shown form of another lemma' END AS violation FROM bad JOIN n USING (card_id) WHERE m = ' ' OR n > 1 OR lower(df) <> lemma""")
def card_catalogue_violations(spark, sf_dir):
    n = F.substring("card_id", 2, 9).cast("int")
    c = card_table(spark, sf_dir).withColumns({"meaning_zh": F.when(n % 7 == 0, " ").otherwise(F.col("meaning_zh")), "display_form": F.when(n % 11 == 0, "other").otherwise(F.col("display_form")), "card_id": F.when(n % 10 == 0, "c10").otherwise(F.col("card_id"))})
    return cards.catalogue_violations(c)


@query("""WITH w AS (SELECT 'W' || (doc_id % 50) AS paper_id, 'l' || (doc_id % 70) AS lemma, CASE WHEN doc_id % 3 = 0 THEN 'en' ELSE ' ' END AS en, 'zh' AS zh, doc_id FROM documents), g AS (SELECT DISTINCT 'W' || (item_id % 50) AS paper_id, 'l' || (item_id % 70) AS lemma FROM benchmark)
SELECT doc_id, CASE WHEN trim(en) = '' AND g.lemma IS NOT NULL THEN 'gloss' ELSE en END AS meaning_en, CASE WHEN trim(en) = '' AND g.lemma IS NOT NULL THEN '释' ELSE zh END AS meaning_zh FROM w LEFT JOIN g ON w.paper_id = g.paper_id AND w.lemma = g.lemma""")
def hydrated_words(spark, sf_dir):
    key = lambda c: (F.concat(F.lit("W"), (F.col(c) % 50).cast("string")).alias("paper_id"), F.concat(F.lit("l"), (F.col(c) % 70).cast("string")).alias("lemma"))
    w = table(spark, sf_dir, "documents").select("doc_id", *key("doc_id"), F.when(F.col("doc_id") % 3 == 0, "en").otherwise(" ").alias("meaning_en"), F.lit("zh").alias("meaning_zh"))
    g = table(spark, sf_dir, "benchmark").select(*key("item_id"), F.lit("gloss").alias("meaning_en"), F.lit("释").alias("meaning_zh")).distinct()
    return cards.hydrated(w, g).select("doc_id", "meaning_en", "meaning_zh")


@query(f"""WITH {PAPERS}, v AS (SELECT 'W' || (doc_id % 40) AS paper_id, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT 'W' || x AS paper_id, count(*) AS n FROM (SELECT DISTINCT p_partkey, unnest([p_partkey % 30, p_partkey % 45, 3]) AS x FROM part) GROUP BY 1)
SELECT paper_id, coalesce(v.n, 0) AS estimated_unfamiliar_words, coalesce(t.n, 0) AS estimated_terms FROM papers LEFT JOIN v USING (paper_id) LEFT JOIN t USING (paper_id)""")
def paper_details(spark, sf_dir):
    w = lambda c: F.concat(F.lit("W"), c.cast("string"))
    v = table(spark, sf_dir, "documents").select(w(F.col("doc_id") % 40).alias("paper_id"), F.col("doc_id").alias("lemma"))
    k = F.col("p_partkey")
    t = table(spark, sf_dir, "part").select(k.alias("term"), F.array(w(k % 30), w(k % 45), F.lit("W3")).alias("source_papers"))
    return cards.paper_details(papers(spark, sf_dir), v, t).select("paper_id", "estimated_unfamiliar_words", "estimated_terms")


@query(f"""WITH {lexicon.VOCAB}, w AS (SELECT lemma, CASE length(lemma) % 5 WHEN 0 THEN 'A1' WHEN 1 THEN 'B2' END AS cefr_level, CASE length(lemma) % 4 WHEN 0 THEN ['gk', 'cet6'] WHEN 1 THEN ['cet4'] ELSE []::VARCHAR[] END AS tags, CASE WHEN length(lemma) % 3 = 0 THEN length(lemma) / 2.0 ELSE 0.0 END AS zipf FROM vocab)
SELECT lemma, cefr_level, array_to_string(list_filter(tags, lambda t: t IN ('gk', 'cet4')), ' ') AS exam_tags, zipf::DOUBLE AS zipf FROM w""")
def word_dimensions(spark, sf_dir):
    w = lexicon.vocab(spark, sf_dir).select("lemma")
    n = F.length("lemma")
    levels = w.where(n % 5 < 2).select("lemma", F.when(n % 5 == 0, "A1").otherwise("B2").alias("cefr_level"))
    tags = w.where(n % 4 < 2).select("lemma", F.when(n % 4 == 0, F.array(F.lit("gk"), F.lit("cet6"))).otherwise(F.array(F.lit("cet4"))).alias("exam_tags"))
    zipf = w.where(n % 3 == 0).select("lemma", (n / 2.0).alias("zipf"))
    out = cards.words_with_dimensions(w.select(F.upper("lemma").alias("lemma")), levels, tags, zipf, "cet4")
    return out.select("lemma", "cefr_level", F.array_join("exam_tags", " ").alias("exam_tags"), "zipf")
