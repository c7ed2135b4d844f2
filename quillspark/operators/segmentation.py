"""Words that have run together, cut into the words of a lexicon.

Substrings of a word meet the lexicon in a join on equality, no longer than its longest
term; the best cut is then a dynamic program over the word's letters, for Arrow batches of
words. Its order of preference is that of Garbe's symmetric-delete speller without edits.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log10

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The size of the corpus that makes frequencies probabilities; a letter outside the lexicon is ten times rarer each.
CORPUS = 1_024_908_267_229


def known_log(frequency: int) -> float:
    return round(log10(frequency / CORPUS), 9)


def unknown_log(letters: int) -> float:
    return round(1.0 - log10(CORPUS) - letters, 9)


def best_cut(word: str, known: dict[tuple[int, int], int], longest: int) -> tuple[str, int]:
    """The parts of a word joined by spaces, and their distance: a cut counts one, a part outside the lexicon its letters.

    known: the frequencies of lexicon words by (place, letters). Parts have at most
    `longest` letters. A way to a place replaces the one before, tried from the left, if its
    distance is less; or if it is the same, but for one cut at most, and its logarithms of
    probability add up to more.
    """
    n = len(word)
    distance, logs, back = [0] * (n + 1), [0.0] * (n + 1), [-1] * (n + 1)
    for to in range(1, n + 1):
        for at in range(max(0, to - longest), to):
            size = to - at
            own = known.get((at, size))
            lacking, log = (0, known_log(own)) if own else (size, unknown_log(size))
            bare = distance[at] + lacking
            whole, total = bare + (at > 0), logs[at] + log
            if back[to] < 0 or whole < distance[to] or (distance[to] in (bare, whole) and logs[to] < total):
                distance[to], logs[to], back[to] = whole, total, at
    parts, to = [], n
    while to > 0:
        parts.append(word[back[to] : to])
        to = back[to]
    return " ".join(reversed(parts)), distance[n]


def segmentations(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """lemma, segmentation_suggestion, segmentation_distance_sum of distinct words (lemma), by a lexicon (term, frequency).

    Hyphens go first. A word of n letters gives at most n times the letters of the longest
    term as substrings, so long words stay linear; empty words and a null stay out, and with
    an empty lexicon each letter is a part that lacks.
    """
    lengths = [r[0] for r in lexicon.where("frequency > 0 and length(term) > 0").select(F.length("term")).distinct().collect()]  # lengths of words
    longest = max(lengths, default=1)
    own = words.where("lemma is not null").select("lemma", F.replace("lemma", F.lit("-"), F.lit("")).alias("_w")).where("_w <> ''").distinct()
    sizes = F.array(*[F.lit(n) for n in sorted(lengths)]).cast("array<int>")
    parts = own.select("lemma", F.col("_w"), F.explode(sizes).alias("_n")).where(F.length("_w") >= F.col("_n"))
    parts = parts.select("lemma", "_n", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("_w") - F.col("_n") + 1), lambda i: F.substring(F.col("_w"), i, F.col("_n")))).alias("_at", "term"))
    lex = lexicon.where("frequency > 0").groupBy("term").agg(F.max("frequency").alias("frequency"))
    found = parts.join(lex, "term").groupBy("lemma").agg(F.collect_list(F.struct("_at", "_n", F.col("frequency").cast("long").alias("f"))).alias("_known"))  # of one word

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lemmas, raw, known = (batch.column(i).to_pylist() for i in range(3))
            made = [best_cut(w, {(x["_at"], x["_n"]): x["f"] for x in k or ()}, longest) for w, k in zip(raw, known, strict=True)]
            yield pa.record_batch([lemmas, [m[0] for m in made], [m[1] for m in made]], names=["lemma", "segmentation_suggestion", "segmentation_distance_sum"])

    return own.join(found, "lemma", "left").select("lemma", "_w", "_known").mapInArrow(run, "lemma string, segmentation_suggestion string, segmentation_distance_sum long")
