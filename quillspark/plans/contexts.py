"""Queries over the contexts of terms and words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import contexts
from quillspark.operators import lexicon as lx
from quillspark.plans.base import query
from quillspark.plans.lexicon import LEXICON, TERMS, VOCAB, documents, spelling_lexicon, terms, vocab
from quillspark.shared import written

R, WORDS_OF = contexts.REACH, r"([\p{L}\p{N}_]+)"


def marked(sql: str) -> str:
    """SQL of a text in lower case with marks around each word, so that whole words are found as plain parts."""
    return f"regexp_replace(lower({sql}), '{WORDS_OF}', chr(2) || '\\1' || chr(3), 'g')"


#: The longest part between sentence marks around each term, looked for on each sentence that has the term's words in their order.
CONTEXTS = rf"""said AS (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS sent FROM
  (SELECT doc_id, regexp_extract_all(regexp_replace(text, '\s+', ' ', 'g'), '[^.!?]*[.!?]') AS s FROM documents)),
keyed AS (SELECT term, {marked("term")} AS mark, regexp_extract_all(term, '{WORDS_OF}') AS w FROM terms),
toks AS (SELECT doc_id, sent, regexp_extract_all(lower(sentence), '{WORDS_OF}') AS w FROM said),
ngs AS (SELECT DISTINCT doc_id, sent, array_to_string(w[i:i + k - 1], ' ') AS key FROM (SELECT doc_id, sent, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM toks, (SELECT DISTINCT len(w) AS k FROM keyed) WHERE len(w) >= k)),
met AS (SELECT doc_id, sent, sentence, term, mark, greatest(0, length(sentence) - 1 - {R} - length(term)) AS low FROM ngs JOIN keyed ON key = array_to_string(w, ' ') JOIN said USING (doc_id, sent)),
tails AS (SELECT *, CASE WHEN low > 0 THEN ltrim({marked("sentence[low:]")}, chr(2)) ELSE {marked("sentence")} END AS tail FROM met),
placed AS (SELECT *, greatest(0, low - 1) + length(replace(replace(left(tail, strpos(tail, mark) - 1), chr(2), ''), chr(3), '')) AS place FROM tails WHERE contains(tail, mark)),
parts AS (SELECT doc_id, sent, term, trim(sentence[greatest(0, place - {R}) + 1:], ' ') AS context FROM placed),
contexts AS (SELECT doc_id, term, arg_max(context, (length(context), -sent)) AS context FROM parts GROUP BY ALL)"""


def found(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Terms of the corpus and their contexts."""
    own = written(terms(spark, sf_dir).select("term", "total_count", "document_count"), "terms")
    forms = own.select("term", F.col("term").alias("form"), F.lit(0).alias("rank"))
    return own, contexts.term_contexts(documents(spark, sf_dir), forms)


@query(f"WITH {TERMS}, {CONTEXTS} SELECT doc_id, term, context FROM contexts")
def term_contexts(spark, sf_dir):
    """The longest context of each term in each of its source documents."""
    return found(spark, sf_dir)[1]


@query(f"WITH {TERMS}, {CONTEXTS} SELECT term, total_count, document_count, count(*) AS sources, min(doc_id) AS first_source, max(doc_id) AS last_source FROM contexts JOIN terms USING (term) GROUP BY ALL")
def term_sources(spark, sf_dir):
    """Terms with the documents they have contexts in."""
    made = contexts.with_sources(*found(spark, sf_dir))
    papers = F.col("source_papers")
    return made.select("term", "total_count", "document_count", F.size(papers).cast("long").alias("sources"), F.element_at(papers, 1).alias("first_source"), F.element_at(papers, -1).alias("last_source"))


#: Words that the lexicon lacks, and the window around the first place of each in each document.
WORDS = f"""queue AS (SELECT lemma FROM vocab WHERE lemma NOT IN (SELECT term FROM lex)),
sents AS (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS sent FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM documents)),
ws AS (SELECT doc_id, sent, sentence, unnest(w) AS form, generate_subscripts(w, 1) AS k, w, string_split_regex(sentence, '[A-Za-z]+') AS p FROM (SELECT *, regexp_extract_all(sentence, '[A-Za-z]+') AS w FROM sents)),
own AS (SELECT doc_id, lower(form) AS lemma, count(*) AS n, min((sent, k)) AS f FROM ws WHERE lower(form) IN (SELECT lemma FROM queue) GROUP BY ALL),
placed AS (SELECT own.doc_id, lemma, n, sentence, length(form) AS size, (list_sum(list_transform(p[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:k - 1], lambda x: length(x))), 0))::INT AS a FROM own JOIN ws ON ws.doc_id = own.doc_id AND ws.sent = f[1] AND ws.k = f[2]),
c AS (SELECT *, a + size AS z, length(sentence) AS len, greatest(0, (2 * a + size) // 2 - 250) AS begun FROM placed),
e AS (SELECT *, least(len, begun + 500) AS r, greatest(0, least(len, begun + 500) - 500) AS l FROM c),
g AS (SELECT *, sentence[l + 1:least(a, l + 80)] AS head, sentence[greatest(z, r - 80) + 1:r] AS foot FROM e),
h AS (SELECT *, CASE WHEN l > 0 AND instr(head, ' ') > 0 THEN l + instr(head, ' ') ELSE l END AS x, greatest(z, r - 80) + length(foot) - instr(reverse(foot), ' ') AS sp FROM g),
y AS (SELECT *, CASE WHEN r < len AND contains(foot, ' ') AND sp > z THEN sp ELSE r END AS t FROM h),
windows AS (SELECT doc_id, lemma, n, CASE WHEN len <= 500 THEN trim(regexp_replace(sentence, '\\s+', ' ', 'g')) ELSE
  (CASE WHEN x > 0 THEN '… ' ELSE '' END) || trim(regexp_replace(sentence[x + 1:t], '\\s+', ' ', 'g')) || (CASE WHEN t < len THEN ' …' ELSE '' END) END AS context FROM y)"""


@query(f"WITH {VOCAB}, {LEXICON}, {WORDS} SELECT doc_id, lemma, n, context FROM windows")
def word_contexts(spark, sf_dir):
    """Words of the review queue in each document: how often, and a window around the first place."""
    queue = lx.orthography_queue(vocab(spark, sf_dir), spelling_lexicon(spark, sf_dir))
    return contexts.word_contexts(documents(spark, sf_dir), queue)
