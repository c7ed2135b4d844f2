"""Queries over the lexical model of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import lexicon as lx
from quillspark.operators import segmentation
from quillspark.plans.base import query, table

#: Words at whose ends terms don't stand.
STOP = ("the", "of", "and", "to", "in", "is", "a", "an", "for", "on", "with", "from", "by", "it", "as", "at", "be")
STOP_SQL = ", ".join(f"'{w}'" for w in STOP)

TOKENS = """tokens AS (
  SELECT doc_id, pos, form, lower(form) AS lemma FROM (
    SELECT doc_id, unnest(w) AS form, generate_subscripts(w, 1) - 1 AS pos
    FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z][A-Za-z''-]*') AS w FROM documents))
  WHERE length(form) >= 2)"""
COUNTS = f"{TOKENS}, counts AS (SELECT doc_id, lemma, count(*) AS n FROM tokens GROUP BY ALL)"


def vocab_sql(facts: str) -> str:
    return f"""vocab AS (
  SELECT lemma, total_count, document_count, round(document_count / d, 6) AS document_share,
         round(total_count * 1e6 / t, 3) AS frequency_per_million,
         round(CASE WHEN d <= 1 THEN 1.0 ELSE greatest(0.0, least(1.0, 1 - sqrt(greatest(sq / d - (total_count / d) * (total_count / d), 0.0)) / (total_count / d) / sqrt(d - 1))) END, 6) AS dispersion
  FROM (SELECT lemma, sum(n)::BIGINT AS total_count, count(*) AS document_count, sum(n::DOUBLE * n) AS sq FROM {facts} GROUP BY lemma),
       (SELECT count(*) AS d FROM documents), (SELECT sum(n) AS t FROM {facts})
  WHERE CASE WHEN d >= 3 THEN total_count >= 3 AND document_count >= 2 ELSE total_count >= 2 END)"""


VOCAB = f"{COUNTS}, {vocab_sql('counts')}"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return lx.vocabulary(lx.lemma_counts(lx.tokens(docs)), docs)


@query(f"WITH {VOCAB} SELECT * FROM vocab ORDER BY document_count DESC, dispersion DESC, total_count DESC, lemma")
def vocabulary_map(spark, sf_dir):
    return vocab(spark, sf_dir).orderBy(F.desc("document_count"), F.desc("dispersion"), F.desc("total_count"), "lemma")


@query(f"WITH {COUNTS} SELECT doc_id, lemma, n FROM counts")
def lemma_doc_counts(spark, sf_dir):
    return lx.lemma_counts(lx.tokens(documents(spark, sf_dir)))


@query(f"""WITH {TOKENS}, forms AS (SELECT lemma, form, count(*) AS n, min((doc_id, pos)) AS f FROM tokens GROUP BY ALL)
SELECT lemma, form, n, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lemma ORDER BY n DESC, f) AS rank FROM forms) WHERE rank <= 8""")
def surface_forms_top8(spark, sf_dir):
    return lx.surface_forms(lx.tokens(documents(spark, sf_dir)))


@query(f"""WITH {TOKENS}, tags AS (SELECT lemma, CASE WHEN regexp_matches(form, '(ing|ed)$') THEN 'VERB' WHEN regexp_matches(form, 'ly$') THEN 'ADV'
  WHEN regexp_matches(form, '(able|ible|ive|ous|al)$') THEN 'ADJ' ELSE 'NOUN' END AS part_of_speech, count(*) AS n, min((doc_id, pos)) AS f FROM tokens GROUP BY ALL)
SELECT lemma, part_of_speech FROM (SELECT *, row_number() OVER (PARTITION BY lemma ORDER BY n DESC, f) AS r FROM tags) WHERE r = 1""")
def modal_part_of_speech(spark, sf_dir):
    return lx.modal_pos(lx.tokens(documents(spark, sf_dir)))


@query("""WITH sents AS (SELECT doc_id, unnest(s) AS raw, generate_subscripts(s, 1) - 1 AS sent FROM
  (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM documents)),
said AS (SELECT doc_id, sent, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS sentence FROM sents),
held AS (SELECT DISTINCT doc_id, sent, sentence, lower(unnest(regexp_extract_all(sentence, '[A-Za-z][A-Za-z''-]*'))) AS lemma FROM said WHERE length(sentence) BETWEEN 35 AND 500),
once AS (SELECT lemma, sentence, min((doc_id, sent)) AS a FROM held WHERE length(lemma) >= 2 GROUP BY ALL)
SELECT lemma, rank::INT AS rank, a[1] AS doc_id, sentence FROM (SELECT *, row_number() OVER (PARTITION BY lemma ORDER BY a) AS rank FROM once) WHERE rank <= 3""")
def representative_examples(spark, sf_dir):
    return lx.examples(documents(spark, sf_dir))


@query("""WITH c AS (SELECT len(regexp_extract_all(text, '[A-Za-z]+'))::BIGINT AS n FROM documents)
SELECT count(*) AS documents, sum(n)::BIGINT AS words, quantile_cont(n, 0.5)::DOUBLE AS median_words, count(*) FILTER (n < 100) AS low_extraction, max(n) AS longest FROM c""")
def corpus_stats(spark, sf_dir):
    return lx.corpus_stats(documents(spark, sf_dir))


TERMS = f"""lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS no FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
ws AS (SELECT doc_id, no, regexp_extract_all(line, '[A-Za-z][A-Za-z''-]*') AS w FROM lines),
grams AS (SELECT doc_id, k AS size, lower(array_to_string(w[i:i + k - 1], ' ')) AS term FROM
  (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM ws, (SELECT unnest([2, 3, 4, 5, 6]) AS k) WHERE len(w) >= k)),
kept AS (SELECT * FROM grams WHERE length(term) >= 5 AND string_split(term, ' ')[1] NOT IN ({STOP_SQL}) AND string_split(term, ' ')[-1] NOT IN ({STOP_SQL})),
terms AS (SELECT term, size, sum(n)::BIGINT AS total_count, count(*) AS document_count FROM (SELECT doc_id, term, size, count(*) AS n FROM kept GROUP BY ALL) GROUP BY ALL
  HAVING total_count >= 2 AND document_count >= 2)"""


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lx.corpus_terms(documents(spark, sf_dir), stop=STOP)


@query(f"WITH {TERMS} SELECT term, total_count, document_count FROM terms")
def term_candidates_ngram(spark, sf_dir):
    return terms(spark, sf_dir).select("term", "total_count", "document_count")


C_VALUES = f"""{TERMS}, parents AS (SELECT total_count AS f, string_split(term, ' ') AS w, size FROM terms WHERE size > 2),
around AS (SELECT term, avg(f) AS around FROM (SELECT f, array_to_string(w[i:i + k - 1], ' ') AS term FROM
  (SELECT f, w, k, unnest(generate_series(1, size - k + 1)) AS i FROM parents, (SELECT unnest([2, 3, 4, 5]) AS k) WHERE k < size)) GROUP BY term),
cv AS (SELECT term, total_count, document_count, round(greatest(0.0, log2(size) * (total_count - coalesce(around, 0.0))), 6) AS c_value FROM terms LEFT JOIN around USING (term))"""


@query(f"WITH {C_VALUES} SELECT * FROM cv ORDER BY document_count DESC, c_value DESC, total_count DESC, term")
def c_value_terms(spark, sf_dir):
    found = lx.c_values(terms(spark, sf_dir), STOP)
    return found.orderBy(F.desc("document_count"), F.desc("c_value"), F.desc("total_count"), "term")


@query(f"WITH {TERMS} SELECT term, total_count, document_count FROM terms WHERE document_count >= greatest(1, ceil((SELECT count(*) FROM documents) * 0.10))")
def shared_terminology(spark, sf_dir):
    return lx.shared_terms(terms(spark, sf_dir)).select("term", "total_count", "document_count")


#: Documents with a mark-up of acronyms: three words before one in brackets, made of each text's own words.
MARKED = """marked AS (SELECT doc_id, w[1] || ' ' || w[2] || ' ' || w[3] || CASE WHEN doc_id % 3 = 0 THEN 's' ELSE '' END || ' (' || upper(w[1][1] || w[2][1] || w[3][1]) || ') ' || text AS text FROM
  (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents) WHERE len(w) >= 3)"""
PATTERN = text.ACRONYM.replace("'", "''")
ACRONYMS = f"""{MARKED}, m AS (SELECT unnest(regexp_extract_all(text, '{PATTERN}')) AS m FROM marked),
acr AS (SELECT acronym, lower(trim(regexp_replace(e, '\\s+', ' ', 'g'))) AS expansion, count(*) AS n FROM
  (SELECT regexp_extract(m, '{PATTERN}', 1) AS e, regexp_extract(m, '{PATTERN}', 2) AS acronym FROM m) GROUP BY ALL)"""


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("_w", F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))).where("size(_w) >= 3")
    w = [F.element_at("_w", i) for i in (1, 2, 3)]
    head = F.concat_ws(" ", *w)
    initials = F.upper(F.concat(*[F.substring(x, 1, 1) for x in w]))
    plural = F.when(F.col("doc_id") % 3 == 0, "s").otherwise("")
    return docs.select("doc_id", F.concat(head, plural, F.lit(" ("), initials, F.lit(") "), "text").alias("text"))


@query(f"WITH {ACRONYMS} SELECT acronym, expansion, n FROM acr")
def acronyms(spark, sf_dir):
    return lx.acronyms(marked(spark, sf_dir))


@query(f"""WITH {ACRONYMS}, own AS (SELECT DISTINCT lower(acronym) AS acronym, expansion FROM acr)
SELECT acronym, string_agg(expansion, '|' ORDER BY expansion) AS expansions FROM own a
WHERE NOT EXISTS (SELECT 1 FROM own b WHERE a.acronym = b.acronym AND a.expansion = b.expansion || 's') GROUP BY acronym""")
def acronym_expansions(spark, sf_dir):
    return lx.acronym_expansions(lx.acronyms(marked(spark, sf_dir)))


@query(f"""WITH {TOKENS} SELECT lemma, count(*) FILTER (regexp_matches(form, '^[A-Z][A-Z0-9]+s?$')) AS uppercase_count, count(*) AS observed_count
FROM tokens GROUP BY lemma HAVING uppercase_count >= 2 AND uppercase_count * 2 >= observed_count""")
def acronym_dominance(spark, sf_dir):
    return lx.acronym_dominance(lx.tokens(documents(spark, sf_dir)))


LEXICON = "lex AS (SELECT term, count(*) AS frequency FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM benchmark) WHERE length(term) >= 2 GROUP BY term)"


def spelling_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("term"))
    return words.where(F.length("term") >= 2).groupBy("term").agg(F.count(F.lit(1)).alias("frequency"))


@query(f"WITH {VOCAB}, {LEXICON} SELECT * FROM vocab WHERE lemma NOT IN (SELECT term FROM lex) ORDER BY document_count DESC, total_count DESC, lemma")
def orthography_queue(spark, sf_dir):
    found = lx.orthography_queue(vocab(spark, sf_dir), spelling_lexicon(spark, sf_dir))
    return found.orderBy(F.desc("document_count"), F.desc("total_count"), "lemma")


@query(f"""WITH {VOCAB}, {LEXICON}, queue AS (SELECT lemma FROM vocab WHERE lemma NOT IN (SELECT term FROM lex)),
near AS (SELECT lemma, term, frequency, levenshtein(lemma, term)::INT AS edit_distance FROM queue, lex WHERE abs(length(lemma) - length(term)) <= 2)
SELECT lemma, term, frequency, edit_distance, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lemma ORDER BY edit_distance, frequency DESC, term) AS rank FROM near WHERE edit_distance <= 2) WHERE rank <= 5""")
def spelling_suggestions(spark, sf_dir):
    words = spelling_lexicon(spark, sf_dir)
    return lx.spelling_suggestions(lx.orthography_queue(vocab(spark, sf_dir), words), words)


#: Cuts of all lengths to each place of a word, in rounds over the places; the best so far are lists of a row per word.
SEGMENTS = f"""queue AS (SELECT lemma, replace(lemma, '-', '') AS w FROM vocab WHERE lemma NOT IN (SELECT term FROM lex)), longest AS (SELECT max(length(term)) AS l FROM lex),
parts AS (SELECT lemma, z, n, frequency FROM (SELECT lemma, w, n, unnest(generate_series(1, length(w) - n + 1)) AS z FROM queue, (SELECT DISTINCT length(term) AS n FROM lex) WHERE length(w) >= n)
  JOIN lex ON term = substr(w, z, n)),
known AS (SELECT lemma, map(list((z - 1) * 1000 + n), list(round(log10(frequency / {segmentation.CORPUS}.0), 9))) AS k FROM parts GROUP BY lemma),
cut AS (SELECT lemma, w, k, l, 0 AS z, [{{d: 0, p: 0.0::DOUBLE, s: ''}}] AS best FROM queue LEFT JOIN known USING (lemma), longest WHERE w <> ''
  UNION ALL SELECT lemma, w, k, l, z + 1, list_append(best, list_reduce(list_transform(generate_series(greatest(0, z + 1 - l), z), lambda j: {{
    d: best[j + 1].d + (CASE WHEN j > 0 THEN 1 ELSE 0 END) + CASE WHEN map_extract(k, j * 1000 + z + 1 - j)[1] IS NULL THEN z + 1 - j ELSE 0 END,
    p: best[j + 1].p + coalesce(map_extract(k, j * 1000 + z + 1 - j)[1], round(1.0 - log10({segmentation.CORPUS}.0) - (z + 1 - j), 9)),
    s: best[j + 1].s || (CASE WHEN j > 0 THEN ' ' ELSE '' END) || substr(w, j + 1, z + 1 - j)}}),
    lambda a, b: CASE WHEN b.d < a.d OR ((b.d = a.d OR b.d - 1 = a.d) AND a.p < b.p) THEN b ELSE a END)) FROM cut WHERE z < length(w))"""


@query(f"WITH RECURSIVE {VOCAB}, {LEXICON}, {SEGMENTS} SELECT lemma, best[z + 1].s AS segmentation_suggestion, best[z + 1].d::BIGINT AS segmentation_distance_sum FROM cut WHERE z = length(w)")
def segmentation_suggestions(spark, sf_dir):
    words = spelling_lexicon(spark, sf_dir)
    return segmentation.segmentations(lx.orthography_queue(vocab(spark, sf_dir), words), words)


@query(f"""WITH {COUNTS}, decided AS (SELECT doc_id, CASE WHEN lemma LIKE '%s' THEN left(lemma, length(lemma) - 1) ELSE lemma END AS lemma, n FROM counts WHERE lemma NOT LIKE 'th%' AND length(lemma) > 2),
facts AS (SELECT doc_id, lemma, sum(n)::BIGINT AS n FROM decided GROUP BY ALL), {vocab_sql('facts')} SELECT * FROM vocab""")
def orthography_merge(spark, sf_dir):
    docs = documents(spark, sf_dir)
    counts = lx.lemma_counts(lx.tokens(docs))
    lemma = F.col("lemma")
    action = F.when(lemma.startswith("th") | (F.length(lemma) <= 2), "drop").when(lemma.endswith("s"), "replace").otherwise("keep")
    decisions = counts.select("lemma").distinct().select("lemma", action.alias("action"), F.expr("left(lemma, length(lemma) - 1)").alias("target"))
    return lx.vocabulary(lx.merged_counts(counts, decisions), docs)
