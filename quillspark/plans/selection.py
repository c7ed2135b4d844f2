"""Queries that clean, select and discover documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import cleaning, discovery, merging, selection
from quillspark.plans.base import query, table

KEY = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
TITLE = "split_part(text, chr(10), 1)"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("title", F.element_at(F.split("text", "\n"), 1))


@query(f"""SELECT doc_id, trim(regexp_replace(regexp_replace(lower({TITLE}), '\\b(?:preprint|accepted manuscript|author version)\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS normal,
{KEY.format(TITLE)} AS title_key, regexp_replace(regexp_replace(regexp_replace(lower(trim('doi: 10.1/' || source || 'v2')), '^https?://doi\\.org/', ''), '^doi:\\s*', ''), 'v\\d+$', '') AS identifier FROM documents""")
def title_keys(spark, sf_dir):
    d = documents(spark, sf_dir)
    doi = F.concat(F.lit("doi: 10.1/"), "source", F.lit("v2"))
    return d.select("doc_id", text.title_norm(F.col("title")).alias("normal"), text.title_key(F.col("title")).alias("title_key"), text.identifier_norm(doi).alias("identifier"))


#: Texts broken within words at every fifth position, so that there is something to join.
BROKEN = "regexp_replace(text, '([a-z]{4})([a-z]{4})', '\\1-' || chr(10) || '\\2', 'g')"


@query(f"""SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z]+')) AS words, length(t)::INT AS n, md5(t) AS digest FROM
(SELECT doc_id, regexp_replace({BROKEN}, '([A-Za-z])-' || chr(10) || '([a-z])', '\\1\\2', 'g') AS t FROM documents)""")
def dehyphenate(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    broken = F.regexp_replace("text", "([a-z]{4})([a-z]{4})", "$1-\n$2")
    t = text.dehyphenated(broken)
    return d.select("doc_id", text.word_count(t).cast("long").alias("words"), F.length(t).alias("n"), F.md5(t).alias("digest"))


MARKS = """marked AS (SELECT doc_id, no // 8 AS page, no, trim(regexp_replace(CASE WHEN no % 8 = 0 AND no <> 8 AND doc_id % 2 = 1 THEN 'Running head ' || no WHEN no = 1 AND doc_id % 2 = 0 THEN 'Abstract: ' || line WHEN no IN (3, 5) AND doc_id % 4 = 0 THEN 'Figure ' || no || '. caption'
  WHEN no = 4 AND doc_id % 3 = 0 THEN 'Acknowledgments' WHEN no = 6 AND doc_id % 3 = 0 THEN 'CONCLUSION' WHEN no = 8 AND doc_id % 5 = 0 THEN '7. References' WHEN no = 7 THEN '12.5 ± 33.1 x (9)' WHEN no = 9 THEN 'Page 3 of 12' WHEN no = 2 THEN 'mail a.b@c.org now' ELSE line END, '[ \\t]+', ' ', 'g')) AS line
  FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS no FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)))"""


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents with headings, captions, margins and numbers put in at fixed places, pages of 8 lines."""
    n, d, out = F.col("no"), F.col("doc_id"), F.col("line")
    out = F.when(n == 2, "mail a.b@c.org now").otherwise(out)
    out = F.when(n == 9, "Page 3 of 12").otherwise(out)
    out = F.when(n == 7, "12.5 ± 33.1 x (9)").otherwise(out)
    out = F.when((n == 8) & (d % 5 == 0), "7. References").otherwise(out)
    out = F.when((n == 6) & (d % 3 == 0), "CONCLUSION").otherwise(out)
    out = F.when((n == 4) & (d % 3 == 0), "Acknowledgments").otherwise(out)
    out = F.when(n.isin(3, 5) & (d % 4 == 0), F.concat(F.lit("Figure "), n, F.lit(". caption"))).otherwise(out)
    out = F.when((n == 1) & (d % 2 == 0), F.concat(F.lit("Abstract: "), "line")).otherwise(out)
    out = F.when((n % 8 == 0) & (n != 8) & (d % 2 == 1), F.concat(F.lit("Running head "), n)).otherwise(out)
    lines = cleaning.lines(table(spark, sf_dir, "documents"))
    return lines.withColumns({"line": out, "page": F.floor(n / 8)})


HEADING = "(length(line) BETWEEN 2 AND 100 AND NOT regexp_matches(line, '[.?!]$') AND len(regexp_split_to_array(line, '\\s+')) <= 12 AND (regexp_matches(line, '^(?:\\d+(?:\\.\\d+)*[.)]?\\s+)?[A-Z][A-Za-z0-9 /&,:()''\\-]{1,90}$') OR (upper(line) = line AND lower(line) <> line)))"
COMPACT = "regexp_replace(line, '\\s+', '', 'g')"
LINE_KEY = "trim(trim(regexp_replace(regexp_replace(lower(trim(line)), '[0-9]+', '#', 'g'), '\\s+', ' ', 'g')), ' -–—|·')"
MARGINS = f"""sides AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY no) AS up, row_number() OVER (PARTITION BY doc_id, page ORDER BY no DESC) AS down FROM marked WHERE trim(line) <> ''),
keys AS (SELECT doc_id, {LINE_KEY} AS key, count(DISTINCT page) AS pages_with FROM sides WHERE (up <= 3 OR down <= 3) AND length(trim(line)) <= 160 GROUP BY ALL),
margins AS (SELECT doc_id, key, pages_with FROM keys JOIN (SELECT doc_id, count(DISTINCT page) AS p FROM marked GROUP BY doc_id) USING (doc_id) WHERE p >= 3 AND key <> '' AND pages_with >= greatest(3, ceil(p * 0.4)))"""
CLEAN = f"""{MARKS}, {MARGINS},
zero AS (SELECT m.doc_id, page, no, line, CASE WHEN line = '' THEN NULL WHEN key IS NOT NULL OR regexp_matches(line, '^(?i)(?:page\\s+)?\\d+(?:\\s+of\\s+\\d+)?$') THEN 'margin'
  WHEN length({COMPACT}) >= 8 AND len(regexp_extract_all({COMPACT}, '[0-9]')) >= 3 AND len(regexp_extract_all({COMPACT}, '[0-9.,;%±−–—()\\[\\]{{}}:+=*/<>]')) / length({COMPACT}) >= 0.58 THEN 'numeric' END AS gone
  FROM marked m LEFT JOIN margins k ON m.doc_id = k.doc_id AND line <> '' AND {LINE_KEY} = key),
one AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS nth FROM zero WHERE gone IS NULL),
two AS (SELECT *, min(CASE WHEN regexp_matches(line, '^(?i)\\s*abstract') AND nth <= 180 THEN no END) OVER (PARTITION BY doc_id) AS head FROM one),
three AS (SELECT doc_id, page, no, head, CASE WHEN no = head THEN trim(regexp_extract(line, '(?i)^\\s*abstract\\s*(?:[—–:\\-]\\s*)?(.*)$', 1)) ELSE line END AS line FROM two
  WHERE no >= head OR head IS NULL AND NOT regexp_matches(line, '\\b[\\w.+-]+@[\\w.-]+\\.\\w+\\b')),
four AS (SELECT *, min(CASE WHEN regexp_matches(line, '(?i)^(?:\\d+(?:\\.\\d+)*[.)]?\\s+)?(?:references|bibliography|works cited)\\s*$') THEN no END) OVER (PARTITION BY doc_id) AS stop FROM three WHERE head IS NULL OR no > head OR line <> ''),
five AS (SELECT *, CASE WHEN regexp_matches(line, '(?i)^(?:\\d+(?:\\.\\d+)*[.)]?\\s+)?acknowledg(?:e)?ments?\\s*$') THEN 'on' WHEN {HEADING} THEN 'off' END AS ev FROM four WHERE stop IS NULL OR no < stop),
six AS (SELECT *, last_value(ev IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS skip FROM five),
seven AS (SELECT *, CASE WHEN regexp_matches(line, '^(?i:fig(?:ure)?|table)\\s*\\d+[A-Za-z]?[.:\\-]?\\s*') THEN trim(regexp_replace(regexp_replace(lower(regexp_replace(line, '^(?i:fig(?:ure)?|table)\\s*\\d+[A-Za-z]?[.:\\-]?\\s*', '')), '[0-9]+', '#', 'g'), '\\s+', ' ', 'g')) END AS caption FROM six WHERE skip IS NULL OR skip = 'off'),
eight AS (SELECT *, row_number() OVER (PARTITION BY doc_id, caption ORDER BY no) AS nth FROM seven),
cleaned AS (SELECT doc_id, no, line FROM eight WHERE caption IS NULL OR nth = 1)"""


@query(f"WITH {CLEAN} SELECT doc_id, no::INT AS no, line FROM cleaned")
def clean_lines(spark, sf_dir):
    return cleaning.clean(marked(spark, sf_dir))


@query(f"""WITH {CLEAN}, b AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(string_agg(line, chr(10) ORDER BY no), '([A-Za-z])-\\n([a-z])', '\\1\\2', 'g'), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS t FROM cleaned GROUP BY doc_id)
SELECT doc_id, md5(t) AS digest, len(regexp_extract_all(t, '[A-Za-z]+'))::INT AS body_word_count, len(regexp_extract_all(t, '[A-Za-z]+')) < 100 AS low_extraction FROM b""")
def clean_bodies(spark, sf_dir):
    made = cleaning.body(cleaning.clean(marked(spark, sf_dir)))
    return made.select("doc_id", F.md5("clean_text").alias("digest"), "body_word_count", "low_extraction")


@query(f"""WITH {CLEAN}, a AS (SELECT doc_id, count(DISTINCT page) AS page_count, count(*) FILTER (gone = 'margin') AS removed_repeated_margin_lines, count(*) FILTER (gone = 'numeric') AS removed_numeric_lines FROM zero GROUP BY doc_id),
h AS (SELECT doc_id, max(head) IS NOT NULL AS h FROM two GROUP BY doc_id), s AS (SELECT doc_id, max(stop) IS NOT NULL AS s FROM four GROUP BY doc_id), c AS (SELECT doc_id, count(*) FILTER (caption IS NOT NULL AND nth > 1) AS c FROM eight GROUP BY doc_id)
SELECT doc_id, page_count, coalesce(h, false) AS abstract_heading_found, coalesce(s, false) AS stopped_at_references, removed_repeated_margin_lines, removed_numeric_lines, coalesce(c, 0) AS removed_duplicate_captions
FROM a LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id) LEFT JOIN c USING (doc_id)""")
def cleaning_diagnostics(spark, sf_dir):
    return cleaning.diagnostics(marked(spark, sf_dir))


@query(f"WITH {MARKS}, {MARGINS} SELECT * FROM margins")
def margin_lines(spark, sf_dir):
    return cleaning.margin_lines(marked(spark, sf_dir).withColumn("line", F.trim(F.regexp_replace("line", r"[ \t]+", " "))))


KEYED = f"keyed AS (SELECT doc_id, {KEY.format(TITLE)} AS k, len(regexp_extract_all(text, '[A-Za-z]+')) AS words FROM documents)"


@query(f"""WITH {KEYED}, r AS (SELECT *, first_value(doc_id) OVER (PARTITION BY CASE WHEN k = '' THEN '-' || doc_id ELSE '+' || k END ORDER BY words DESC, doc_id) AS best FROM keyed)
SELECT doc_id, CASE WHEN best <> doc_id THEN 'duplicate' ELSE 'include' END AS decision, CASE WHEN best <> doc_id THEN best::VARCHAR END AS duplicate_of FROM r""")
def exact_duplicates(spark, sf_dir):
    d = documents(spark, sf_dir)
    found = selection.exact_duplicates(d.select("doc_id", text.title_key(F.col("title")).alias("title_key"), text.word_count(F.col("text")).alias("words")))
    return found.withColumn("duplicate_of", F.col("duplicate_of").cast("string"))


PAIRS = f"""t AS (SELECT DISTINCT {KEY.format(TITLE)} AS title FROM documents), w AS (SELECT title, list_distinct(string_split(title, ' ')) AS s FROM t WHERE title <> ''),
pairs AS (SELECT a.title AS a, b.title AS b, len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) AS jaccard FROM w a, w b WHERE a.title < b.title
  AND len(list_intersect(a.s, b.s)) >= 0.85 * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))))"""


@query(f"WITH {PAIRS} SELECT a, b, round(jaccard, 6) AS jaccard FROM pairs")
def near_duplicate_pairs(spark, sf_dir):
    titles = documents(spark, sf_dir).select(text.title_key(F.col("title")).alias("title"))
    return selection.title_pairs(titles).withColumn("jaccard", F.round("jaccard", 6))


UNIT = "vecs AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings)"


@query(f"""WITH RECURSIVE {PAIRS}, {UNIT}, d AS (SELECT doc_id, {KEY.format(TITLE)} AS title, len(regexp_extract_all(text, '[A-Za-z]+')) AS words, v FROM documents LEFT JOIN vecs ON id = doc_id % (SELECT count(*) FROM vecs)),
e AS (SELECT *, first_value(doc_id) OVER (PARTITION BY CASE WHEN title = '' THEN '-' || doc_id ELSE '+' || title END ORDER BY words DESC, doc_id) AS best FROM d),
o AS (SELECT *, row_number() OVER (ORDER BY words DESC, doc_id) AS r FROM e WHERE best = doc_id),
p AS (SELECT greatest(x.r, y.r) AS later, least(x.r, y.r) AS earlier, jaccard, list_cosine_similarity(x.v, y.v) AS cosine FROM pairs JOIN o x ON a = x.title JOIN o y ON b = y.title),
m AS (SELECT later, list(earlier) AS es, row_number() OVER (ORDER BY later) AS step FROM p WHERE cosine >= 0.97 GROUP BY later),
walk AS (SELECT 0::BIGINT AS step, []::BIGINT[] AS gone UNION ALL
  SELECT m.step, CASE WHEN len(list_filter(m.es, lambda x: NOT list_contains(gone, x))) > 0 THEN list_append(gone, m.later) ELSE gone END FROM walk JOIN m ON m.step = walk.step + 1),
gone AS (SELECT unnest(gone) AS r FROM (SELECT arg_max(gone, step) AS gone FROM walk)),
near AS (SELECT later, min((earlier, jaccard, cosine)) AS k FROM p WHERE cosine >= 0.97 AND later IN (SELECT r FROM gone) AND earlier NOT IN (SELECT r FROM gone) GROUP BY later)
SELECT e.doc_id, CASE WHEN e.best <> e.doc_id OR k IS NOT NULL THEN 'duplicate' ELSE 'include' END AS decision, CASE WHEN e.best <> e.doc_id THEN e.best WHEN k IS NOT NULL THEN (SELECT doc_id FROM o WHERE o.r = k[1]) END AS duplicate_of,
  round(k[2], 6) AS jaccard, round(k[3], 6) AS cosine FROM e LEFT JOIN o ON o.doc_id = e.doc_id LEFT JOIN near ON later = o.r""")
def near_duplicates_resolved(spark, sf_dir):
    """Decisions on documents, each with the vector of its number modulo the table of vectors' rows."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("_id"), F.col("embedding").alias("vector"))
    d = documents(spark, sf_dir).withColumns({c: F.coalesce(c, F.lit("")) for c in ("title", "text")})
    d = d.select("doc_id", text.title_key(F.col("title")).alias("title"), text.word_count(F.col("text")).alias("words"))
    d = d.join(vectors, F.pmod("doc_id", F.lit(max(1, vectors.count()))) == F.col("_id"), "left").drop("_id")
    found = selection.resolved(d)
    return found.withColumns({"jaccard": F.round("jaccard", 6), "cosine": F.round("cosine", 6)})


RELEVANCE = f"""{UNIT}, anchors AS (SELECT * FROM vecs WHERE id < 9),
sims AS (SELECT x.id, a.id AS anchor, list_cosine_similarity(x.v, a.v) AS s FROM vecs x, anchors a),
rel AS (SELECT id, 0.6 * max(s) FILTER (anchor = 0) + 0.4 * list_avg(list_slice(list_reverse_sort(list(s) FILTER (anchor <> 0)), 1, 3)) AS relevance_score FROM sims GROUP BY id)"""


def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    anchors = v.where("vec_id < 9").select(F.col("vec_id").alias("anchor"), F.col("embedding").alias("vector"))
    return selection.relevance(v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), anchors)


@query(f"WITH {RELEVANCE} SELECT id, round(relevance_score, 6) AS relevance_score FROM rel")
def relevance_scores(spark, sf_dir):
    return relevance(spark, sf_dir).withColumn("relevance_score", F.round("relevance_score", 6))


@query(f"""WITH {RELEVANCE}, c AS (SELECT CASE WHEN count(*) >= 8 THEN least(0.22, quantile_cont(relevance_score, 0.10)) END AS cutoff FROM rel)
SELECT id, round(relevance_score, 6) AS relevance_score, round(cutoff, 6) AS cutoff, CASE WHEN relevance_score < cutoff THEN 'low-relevance' ELSE 'include' END AS decision FROM rel, c""")
def relevance_cutoff(spark, sf_dir):
    found = selection.relevance_decisions(relevance(spark, sf_dir))
    return found.withColumns({"relevance_score": F.round("relevance_score", 6), "cutoff": F.round("cutoff", 6)})


@query(f"WITH {UNIT} SELECT label, count(*) AS n, round(avg(sqrt(list_sum(list_transform(v, lambda x: x * x)))), 5) AS mean_norm, count(*) FILTER (list_bool_and(list_transform(v, lambda x: isfinite(x)))) AS finite FROM vecs GROUP BY label")
def embedding_audit(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").withColumn("_v", F.col("embedding").cast("array<double>"))
    finite = F.forall("_v", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.sqrt(selection.dot(F.col("_v"), F.col("_v")))), 5).alias("mean_norm"), F.count_if(finite).alias("finite"))


CANDIDATES = f"""cand AS (SELECT doc_id, source AS query, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank, {KEY.format(TITLE)} AS identity,
  CASE WHEN lang = 'fr' THEN 'foundation' ELSE 'recent' END AS lane FROM documents)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    lane = F.when(F.col("lang") == "fr", "foundation").otherwise("recent")
    return documents(spark, sf_dir).select("doc_id", F.col("source").alias("query"), rank.alias("rank"), text.title_key(F.col("title")).alias("identity"), lane.alias("lane"))


@query(f"WITH {CANDIDATES} SELECT identity, row_number() OVER (ORDER BY a) AS discovery_order FROM (SELECT identity, min((rank, query)) AS a FROM cand GROUP BY identity)")
def interleave_ranks(spark, sf_dir):
    return discovery.interleaved(candidates(spark, sf_dir))


@query(f"""WITH {CANDIDATES}, p AS (SELECT *, row_number() OVER (ORDER BY rank, query) AS position FROM cand),
f AS (SELECT identity, min(position) FILTER (lane = 'foundation') AS f, min(position) FILTER (lane <> 'foundation') AS r FROM p GROUP BY identity),
cut AS (SELECT max(f) AS cut FROM (SELECT f, row_number() OVER (ORDER BY f) AS nth FROM f WHERE f IS NOT NULL AND (r IS NULL OR f < r)) WHERE nth = 25)
SELECT query, rank::INT AS rank, identity, lane, position FROM p, cut WHERE lane <> 'foundation' OR cut IS NULL OR position <= cut""")
def foundation_quota(spark, sf_dir):
    return discovery.foundation_quota(candidates(spark, sf_dir).drop("doc_id"), 25)


@query("""WITH c AS (SELECT doc_id AS "order", coalesce(source, '-') AS bucket FROM documents), p AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY "order") AS n, min("order") OVER (PARTITION BY bucket) AS b FROM c)
SELECT "order", packet_rank FROM (SELECT *, row_number() OVER (ORDER BY n, b) AS packet_rank FROM p) WHERE packet_rank <= greatest(100, (SELECT count(DISTINCT bucket) FROM c))""")
def review_packet(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("order"), F.array(F.coalesce("source", F.lit("-"))).alias("buckets"))
    return merging.review_packet(d, 70)


@query("SELECT source AS provider, source AS query_id, lang AS lane, count(*) AS candidates FROM documents GROUP BY ALL")
def coverage_buckets(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return discovery.coverage(d.select(F.col("source").alias("provider"), F.col("source").alias("query_id"), F.col("lang").alias("lane")))


@query(f"""WITH k AS (SELECT doc_id, unnest(['doi:10.1/' || (doc_id // 3), 'arxiv:' || (doc_id % 500), 'title:' || {KEY.format(TITLE)}, 'candidate:c' || doc_id, 'url:https://h.org/p' || doc_id]) AS key FROM documents)
SELECT key, count(*) AS candidates, min(doc_id) AS first_id FROM k WHERE key <> 'title:' GROUP BY key""")
def candidate_merge_keys(spark, sf_dir):
    d = documents(spark, sf_dir)
    third, half = F.floor(F.col("doc_id") / 3).cast("string"), (F.col("doc_id") % 500).cast("string")
    own = F.col("doc_id").cast("string")
    keys = discovery.identity_keys(F.concat(F.lit("https://dx.doi.org/10.1/"), third), half, F.col("title"), F.concat(F.lit("c"), own), F.concat(F.lit("https://H.org/p"), own, F.lit("/?q=1")))
    return d.select("doc_id", F.explode(keys).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("candidates"), F.min("doc_id").alias("first_id"))


MERGED = f"""cands AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i, CASE WHEN doc_id % 3 = 0 THEN '10.1/' || (doc_id % 200) END AS doi, CASE WHEN doc_id % 5 = 0 THEN '24.' || (doc_id % 150) END AS arxiv,
  CASE WHEN doc_id % 7 = 0 THEN 's' || (doc_id % 90) END AS third, {KEY.format(TITLE)} AS title FROM documents),
walk AS (SELECT 0::BIGINT AS i, MAP {{}}::MAP(VARCHAR, BIGINT) AS ids, MAP {{}}::MAP(BIGINT, VARCHAR) AS dois, MAP {{}}::MAP(BIGINT, VARCHAR) AS arxivs, 0::BIGINT AS doc_id, 0::BIGINT AS m
  UNION ALL SELECT i, map_concat(ids, map_from_entries(list_filter([('d' || doi, m), ('a' || arxiv, m), ('s' || third, m), (CASE WHEN title <> '' THEN 't' || title END, m)], lambda e: e[1] IS NOT NULL))),
    CASE WHEN doi IS NOT NULL AND dois[m] IS NULL THEN map_concat(dois, MAP {{m: doi}}) ELSE dois END, CASE WHEN arxiv IS NOT NULL AND arxivs[m] IS NULL THEN map_concat(arxivs, MAP {{m: arxiv}}) ELSE arxivs END, doc_id, m
  FROM (SELECT c.i, ids, dois, arxivs, c.doc_id, doi, arxiv, third, title, CASE WHEN coalesce(ids['d' || doi], ids['a' || arxiv], ids['s' || third]) IS NOT NULL THEN coalesce(ids['d' || doi], ids['a' || arxiv], ids['s' || third])
    WHEN title <> '' AND ids['t' || title] IS NOT NULL AND NOT coalesce(dois[ids['t' || title]] <> doi, false) AND NOT coalesce(arxivs[ids['t' || title]] <> arxiv, false) THEN ids['t' || title] ELSE c.doc_id END AS m
    FROM walk JOIN cands c ON c.i = walk.i + 1)),
groups AS (SELECT doc_id, m FROM walk WHERE i > 0)"""


def merge_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of documents: a DOI for one in three, an arXiv id for one in five, a third id for one in seven, and titles."""
    d = documents(spark, sf_dir)
    some = lambda n, m, prefix: F.when(F.col("doc_id") % n == 0, F.concat(F.lit(prefix), (F.col("doc_id") % m).cast("string")))
    return d.select(F.col("doc_id").alias("order"), some(3, 200, "10.1/").alias("doi"), some(5, 150, "24.").alias("arxiv_id"), some(7, 90, "s").alias("semantic_scholar_id"), "title", "source", "lang")


@query(f'WITH RECURSIVE {MERGED} SELECT doc_id AS "order", m AS merged_into FROM groups')
def candidate_merge(spark, sf_dir):
    return merging.merge_groups(merge_input(spark, sf_dir))


@query(f"""WITH RECURSIVE {MERGED}, h AS (SELECT doc_id, coalesce(source, '-') AS provider, coalesce(lang, '-') AS query_id, 'l' || doc_id AS label FROM documents),
f AS (SELECT m AS merged_into, provider, query_id, min((h.doc_id, label)) AS k FROM h JOIN groups USING (doc_id) GROUP BY ALL)
SELECT merged_into, row_number() OVER (PARTITION BY merged_into ORDER BY k[1], provider, query_id)::INT AS place, provider, query_id, k[2] AS label FROM f""")
def merged_query_hits(spark, sf_dir):
    c = merge_input(spark, sf_dir)
    own = F.col("order").cast("string")
    hits = c.select("order", F.coalesce("source", F.lit("-")).alias("provider"), F.coalesce("lang", F.lit("-")).alias("query_id"), F.concat(F.lit("l"), own).alias("label"))
    return merging.merged_hits(hits, merging.merge_groups(c))


@query(f"""WITH RECURSIVE {MERGED}, r AS (SELECT doc_id, n AS no, 'https://h' || ((doc_id + n) % 40) || '.org/' || n AS url, coalesce(source, '-') AS provider FROM documents, (SELECT unnest([0, 1]) AS n)),
own AS (SELECT r.*, m AS merged_into FROM r JOIN groups USING (doc_id)),
rest AS (SELECT * FROM own o WHERE (doc_id <> merged_into OR no <> 0) AND NOT EXISTS (SELECT 1 FROM own k WHERE k.doc_id = k.merged_into AND k.no = 0 AND k.merged_into = o.merged_into AND k.url = o.url)),
f AS (SELECT merged_into, url, min((doc_id, no, provider)) AS k FROM rest GROUP BY ALL)
SELECT merged_into, row_number() OVER (PARTITION BY merged_into ORDER BY k[1], k[2])::INT AS route_no, k[3] AS provider, url FROM f""")
def merged_download_routes(spark, sf_dir):
    c = merge_input(spark, sf_dir)
    routes = c.withColumn("no", F.explode(F.array(F.lit(0), F.lit(1))))
    n = F.col("no").cast("string")
    url = F.concat(F.lit("https://h"), ((F.col("order") + F.col("no")) % 40).cast("string"), F.lit(".org/"), n)
    return merging.merged_routes(routes.select("order", "no", F.coalesce("source", F.lit("-")).alias("provider"), url.alias("url")), merging.merge_groups(c))


@query(f"""WITH RECURSIVE a AS (SELECT doc_id, row_number() OVER (ORDER BY len(regexp_extract_all(text, '[A-Za-z]+')) DESC, doc_id) AS i,
  list_filter([CASE WHEN doc_id % 4 = 0 THEN 'doi:10.1/' || (doc_id % 60) END, CASE WHEN doc_id % 6 = 0 THEN 'arxiv:' || (doc_id % 90) END, CASE WHEN {KEY.format(TITLE)} <> '' THEN 'title:' || {KEY.format(TITLE)} END], lambda k: k IS NOT NULL) AS keys
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
shared AS (SELECT k FROM (SELECT unnest(keys) AS k FROM a) GROUP BY k HAVING count(*) > 1),
met AS (SELECT doc_id, i, list(k ORDER BY y) AS keys FROM (SELECT doc_id, i, unnest(keys) AS k, generate_subscripts(keys, 1) AS y FROM a) WHERE k IN (SELECT k FROM shared) GROUP BY ALL),
d AS (SELECT doc_id, row_number() OVER (ORDER BY i) AS i, keys FROM met),
walk AS (SELECT 0::BIGINT AS i, 0::BIGINT AS doc_id, MAP {{}}::MAP(VARCHAR, BIGINT) AS owners, NULL::BIGINT AS dup UNION ALL
  SELECT i, doc_id, CASE WHEN dup IS NULL THEN map_concat(owners, map_from_entries([(k, doc_id) for k in keys])) ELSE owners END, dup FROM
  (SELECT d.i, d.doc_id, owners, keys, list_filter([owners[k] for k in keys], lambda o: o IS NOT NULL)[1] AS dup FROM walk JOIN d ON d.i = walk.i + 1))
SELECT doc_id, CASE WHEN dup IS NULL THEN 'include' ELSE 'duplicate' END AS decision, dup AS duplicate_of FROM walk WHERE i > 0
UNION ALL SELECT doc_id, 'include', NULL FROM a WHERE doc_id NOT IN (SELECT doc_id FROM d)""")
def exact_duplicates_greedy(spark, sf_dir):
    """Duplicates by DOI, arXiv id and title, best extracted first."""
    d = documents(spark, sf_dir).withColumns({c: F.coalesce(c, F.lit("")) for c in ("title", "text")})
    some = lambda n, m, prefix: F.when(F.col("doc_id") % n == 0, F.concat(F.lit(prefix), (F.col("doc_id") % m).cast("string")))
    title = text.title_key(F.col("title"))
    keys = F.array(some(4, 60, "doi:10.1/"), some(6, 90, "arxiv:"), F.when(title != "", F.concat(F.lit("title:"), title)))
    return merging.greedy_exact(d.withColumn("words", text.word_count(F.col("text"))), keys)


@query("""WITH o AS (SELECT event_id, event_type, event_type IN ('purchase', 'click') AS ok FROM events)
SELECT event_id, ok FROM (SELECT *, coalesce(sum(ok::INT) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM o) WHERE done < 70""")
def download_prefix(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").isin("purchase", "click").alias("ok"))
    return discovery.admitted(e, 70, "event_id")


AS_OF = "TIMESTAMP '2024-06-01 00:00:00'"
TIER = f"CASE WHEN d IS NULL THEN 'undated' WHEN d >= CAST({AS_OF} - INTERVAL 14 DAYS AS DATE) THEN 'new' WHEN d >= CAST({AS_OF} - INTERVAL 1460 DAYS AS DATE) THEN 'recent' ELSE 'classic' END"


@query(f"""WITH c AS (SELECT CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(ts - to_days((event_id % 2000)::INT) AS DATE) END AS d FROM events), t AS (SELECT {TIER} AS tier FROM c)
SELECT tier, CASE WHEN tier = 'undated' THEN 'backlog_paper' ELSE tier || '_paper' END AS item_type, count(*) AS n, CASE tier WHEN 'new' THEN 4 WHEN 'recent' THEN 3 WHEN 'classic' THEN 2 ELSE 1 END AS tier_rank FROM t GROUP BY ALL""")
def freshness_tiers(spark, sf_dir):
    date = F.when(F.col("event_id") % 7 != 0, F.expr("cast(date_sub(ts, int(event_id % 2000)) as string)"))
    e = table(spark, sf_dir, "events").select(discovery.candidate_date(date, F.lit(None).cast("int")).alias("d"))
    tier = discovery.freshness(F.col("d"), F.expr("DATE '2024-06-01'"))
    return e.select(tier.alias("tier")).groupBy("tier").agg(F.count(F.lit(1)).alias("n")).select("tier", discovery.item_type(F.col("tier")).alias("item_type"), "n", discovery.freshness_rank(F.col("tier")).alias("tier_rank"))


@query(f"""WITH c AS (SELECT doc_id AS id, unnest(['title:' || {KEY.format(TITLE)}, 'candidate:' || (doc_id % 300)]) AS key FROM documents), seen AS (SELECT DISTINCT 'candidate:' || user_id AS key FROM events)
SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT id FROM c JOIN seen USING (key))""")
def unseen_candidates(spark, sf_dir):
    d = documents(spark, sf_dir)
    keys = discovery.identity_keys(F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("title"), (F.col("doc_id") % 300).cast("string"), F.lit(None).cast("string"))
    seen = table(spark, sf_dir, "events").select(F.concat(F.lit("candidate:"), F.col("user_id").cast("string")).alias("key"))
    return discovery.unseen(d.select(F.col("doc_id").alias("id"), keys.alias("keys")), seen).select("id")


@query(f"""WITH x AS (SELECT doc_id, regexp_extract_all(lower({TITLE}), '[a-z0-9]+') AS t, regexp_extract_all(lower(text[1:12000]), '[a-z0-9]+') AS h FROM documents)
SELECT doc_id, round(len(list_filter(t, lambda w: list_contains(h, w))) / greatest(len(t), 1), 4) AS coverage FROM x""")
def title_token_coverage(spark, sf_dir):
    """Share of the title line's tokens in a text's first 12,000 characters."""
    tokens = lambda c: F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))
    d = documents(spark, sf_dir).select("doc_id", tokens("title").alias("t"), tokens(F.substring("text", 1, 12_000)).alias("h"))
    return d.select("doc_id", discovery.title_evidence(F.col("t"), F.col("h"))[0].alias("coverage"))


IDENTITY = f"""rec AS (SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'study of ' || array_to_string(list_reverse(list_slice(regexp_extract_all({TITLE}, '[A-Za-z]+'), 1, 9)), ' ') WHEN doc_id % 4 = 1 THEN 'wholly other words here' ELSE {TITLE} END AS title,
  CASE WHEN doc_id % 5 = 0 THEN '10.1234/x' || doc_id ELSE '' END AS doi, CASE WHEN doc_id % 7 = 0 THEN '2401.' || doc_id ELSE '' END AS arxiv,
  lower(left(CASE WHEN doc_id % 10 = 0 THEN 'doi 10.1234/x' || doc_id || '. ' WHEN doc_id % 15 = 5 THEN 'see 10.9999/zz9; ' ELSE '' END || CASE WHEN doc_id % 14 = 0 THEN 'arXiv 2401.' || doc_id || ' ' ELSE '' END || text, 12000)) AS head FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
tk AS (SELECT *, regexp_extract_all(lower(title), '[a-z0-9]+') AS t, regexp_extract_all(head, '[a-z0-9]+') AS h, [rtrim(x, '.,;)') for x in regexp_extract_all(head, '10\\.\\d{{4,9}}/[-._;()/:a-z0-9]+')] AS dois FROM rec),
walk AS (SELECT id, 0 AS i, 0::BIGINT AS p, 0 AS n FROM tk UNION ALL SELECT id, i + 1, CASE WHEN f > 0 THEN p + f ELSE p END, n + (f > 0)::INT FROM (SELECT w.id, i, p, n, coalesce(list_position(h[p + 1:], t[i + 1]), 0) AS f FROM walk w JOIN tk ON tk.id = w.id WHERE i < len(t))),
ord AS (SELECT id, max(n) AS n FROM walk GROUP BY id),
ev AS (SELECT tk.*, round(len(list_filter(t, lambda x: list_contains(h, x))) / greatest(len(t), 1), 4) AS cov, round(n / greatest(len(t), 1), 4) AS ordered FROM tk JOIN ord USING (id)),
why AS (SELECT id, cov, ordered, CASE WHEN doi <> '' AND len(dois) > 0 AND NOT list_contains(dois, doi) THEN 'another doi' WHEN doi <> '' AND contains(head, doi) THEN 'doi' WHEN arxiv <> '' AND contains(head, arxiv) THEN 'arxiv_id'
  WHEN len(t) > 0 AND contains(array_to_string(h, ' '), array_to_string(t, ' ')) OR len(t) >= 4 AND cov >= 0.9 AND ordered >= 0.8 THEN 'title' ELSE 'mismatch' END AS reason FROM ev)"""


@query(f"WITH RECURSIVE {IDENTITY} SELECT id, reason IN ('doi', 'arxiv_id', 'title') AS verified, reason, cov AS title_token_coverage, ordered AS ordered_title_coverage FROM why")
def title_identity_check(spark, sf_dir):
    """Whether texts, with a DOI or arXiv id put before some, bear out records with titles of their own, turned round, or others."""
    d = F.col("doc_id")
    s = d.cast("string")
    text_, first = F.coalesce("text", F.lit("")), F.element_at(F.split(F.coalesce("text", F.lit("")), "\n"), 1)
    turned = F.concat(F.lit("study of "), F.array_join(F.reverse(F.slice(F.regexp_extract_all(first, F.lit("([A-Za-z]+)"), F.lit(1)), 1, 9)), " "))
    title = F.when(d % 4 == 0, turned).when(d % 4 == 1, "wholly other words here").otherwise(first)
    front = F.when(d % 10 == 0, F.concat(F.lit("doi 10.1234/x"), s, F.lit(". "))).when(d % 15 == 5, "see 10.9999/zz9; ").otherwise("")
    arxiv = F.concat(F.lit("2401."), s)
    front = F.concat(front, F.when(d % 14 == 0, F.concat(F.lit("arXiv "), arxiv, F.lit(" "))).otherwise(""))
    records = table(spark, sf_dir, "documents").select(d.alias("id"), title.alias("title"), F.when(d % 5 == 0, F.concat(F.lit("https://doi.org/10.1234/X"), s)).alias("doi"), F.when(d % 7 == 0, arxiv).alias("arxiv_id"), F.concat(front, text_).alias("text"))
    return discovery.identity_check(records)
