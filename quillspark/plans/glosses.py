"""Queries over checks of glosses, made of what the corpus says of its acronyms."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import cards, glosses
from quillspark.operators import lexicon as lx
from quillspark.plans.base import query
from quillspark.plans.lexicon import ACRONYMS, marked
from quillspark.shared import written

SLUG = "trim(regexp_replace({0}, '[^a-z0-9]+', '-', 'g'), '-')"
PHRASE = "regexp_replace(array_to_string(regexp_extract_all(lower({0}), '[a-z0-9]+'), ' '), '([a-z0-9])s$', '\\1')"


@query(f"""WITH {ACRONYMS}, own AS (SELECT DISTINCT lower(acronym) AS a, expansion FROM acr),
kept AS (SELECT a, list(expansion ORDER BY expansion) AS e FROM own x WHERE NOT EXISTS (SELECT 1 FROM own b WHERE x.a = b.a AND x.expansion = b.expansion || 's') GROUP BY a),
top AS (SELECT lower(acronym) AS a, max(expansion) AS last, arg_max(expansion, (n, expansion)) AS t FROM acr GROUP BY ALL)
SELECT a AS lemma, CASE WHEN len(e) > 2 THEN 'undecided' WHEN len(e) = 1 AND {SLUG.format('t')} <> {SLUG.format('e[1]')} THEN 'another sense than the expansion''s' WHEN len(e) = 1 AND {PHRASE.format('last')} <> {PHRASE.format('e[1]')} THEN 'another meaning than the expansion' END AS violation
FROM kept JOIN top USING (a) WHERE violation IS NOT NULL""")
def gloss_violations(spark, sf_dir):
    """Acronyms of the texts, glossed by their most frequent expansion; those of three expansions and more are left undecided."""
    counts = written(lx.acronyms(marked(spark, sf_dir)), "acronyms")
    expanded = lx.acronym_expansions(counts).select("acronym", F.split("expansions", r"\|").alias("expansions"))
    none = F.array().cast("array<struct<meaning_en:string,meaning_zh:string>>")
    candidates = expanded.select(F.col("acronym").alias("lemma"), "expansions", cards.suggested_sense(F.col("expansions")).alias("suggested_sense_key"), none.alias("dictionary"))
    top = counts.groupBy(F.lower("acronym").alias("lemma")).agg(F.max("expansion").alias("last"), F.max(F.struct("n", "expansion"))["expansion"].alias("t"))
    slug = F.trim(F.regexp_replace("t", "[^a-z0-9]+", "-"), F.lit("-"))
    made = top.join(candidates.where("size(expansions) <= 2").select("lemma"), "lemma").select("lemma", F.col("last").alias("meaning_en"), F.col("t").alias("meaning_zh"), slug.alias("sense_key"), F.col("t").alias("rationale"))
    return glosses.gloss_violations(candidates, made, made.limit(0).select("lemma"))
