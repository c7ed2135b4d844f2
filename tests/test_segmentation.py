"""Cuts of words that have run together: the rule against all cuts, and long words."""

import itertools
import random

from quillspark.operators.segmentation import best_cut, known_log, segmentations, unknown_log


def score(parts, lexicon):
    d = len(parts) - 1 + sum(len(p) for p in parts if p not in lexicon)
    return d, sum(known_log(lexicon[p]) if p in lexicon else unknown_log(len(p)) for p in parts)


def cuts(word):
    for k in range(len(word)):
        for at in itertools.combinations(range(1, len(word)), k):
            yield [word[a:b] for a, b in zip((0, *at), (*at, len(word)), strict=True)]


def test_known_words(spark):
    lexicon = {"data": 900, "base": 500, "database": 40, "the": 5000, "in": 4000, "info": 10, "form": 300, "inform": 80, "ation": 1, "a": 7000}
    words = ["database", "thedatabase", "in-form", "informdata", "zzz", "theqq", "", None, "the"]
    lex = spark.createDataFrame(list(lexicon.items()), "term string, frequency long")
    got = {r.lemma: (r[1], r[2]) for r in segmentations(spark.createDataFrame([(w,) for w in words], "lemma string"), lex).collect()}
    assert got["database"] == ("database", 0) and got["the"] == ("the", 0) and got["thedatabase"] == ("the database", 1)
    assert got["in-form"] == ("inform", 0) and got["informdata"] == ("inform data", 1) and got["zzz"] == ("zzz", 3)
    assert got["theqq"] == ("the qq", 3) and set(got) == {w for w in words if w}
    none = segmentations(spark.createDataFrame([("ab",)], "lemma string"), lex.where("false")).collect()
    assert [tuple(r) for r in none] == [("ab", "a b", 3)]


def test_distance_is_least():
    """No cut has a distance that is less by more than the rule's trade of one cut for probability allows."""
    rng = random.Random(4)
    for _ in range(300):
        lexicon = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 4))): rng.randint(1, 9) * 10 ** rng.randint(0, 9) for _ in range(rng.randint(1, 6))}
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
        longest = max(map(len, lexicon))
        known = {(i, n): lexicon[word[i : i + n]] for i in range(len(word)) for n in range(1, longest + 1) if i + n <= len(word) and word[i : i + n] in lexicon}
        said, d = best_cut(word, known, longest)
        parts = said.split(" ")
        assert "".join(parts) == word and all(len(p) <= longest for p in parts) and score(parts, lexicon)[0] == d
        least = min(score(c, lexicon)[0] for c in cuts(word) if all(len(p) <= longest for p in c))
        assert least <= d <= least + len(parts)
        same = [score(c, lexicon) for c in cuts(word) if all(len(p) <= longest and p in lexicon for p in c) and len(c) == len(parts)]
        if all(p in lexicon for p in parts):
            assert score(parts, lexicon)[1] >= max(x[1] for x in same) - 1e-6


def test_long_word(spark):
    lex = spark.createDataFrame([("ab", 5), ("cd", 7)], "term string, frequency long")
    got = segmentations(spark.createDataFrame([("abcd" * 2500,)], "lemma string"), lex).first()
    assert got[1] == " ".join(["ab", "cd"] * 2500) and got[2] == 4999
