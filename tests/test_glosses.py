"""Checks of glosses and of review batches on literal rows."""

from quillspark.operators import glosses


def test_gloss_violations(spark):
    one, book = ["support vector machine"], [("support vector machines", "支持向量机"), ("other", "别的")]
    cases = ["ok", "none", "nomean", "nosense", "norat", "sense", "meaning", "copied", "free", "both", "dropped", "twice"]
    candidates = spark.createDataFrame([(c, None if c == "free" else one, "support-vector-machine", book) for c in cases], "lemma string, expansions array<string>, suggested_sense_key string, dictionary array<struct<meaning_en:string,meaning_zh:string>>")
    good = ("Support vector machines", "支持向量机", "support-vector-machine", "said so")
    change = {"nomean": (good[0], " ", *good[2:]), "nosense": (*good[:2], None, good[3]), "norat": (*good[:3], ""), "sense": (*good[:2], "svm", good[3]), "meaning": ("vector machine", *good[1:]), "copied": (good[0], "别的", *good[2:]), "free": ("any", "别的", "s", "r")}
    said = [(c, *change.get(c, good)) for c in cases if c not in ("none", "dropped")] + [("twice", *good), ("extra", *good)]
    said = spark.createDataFrame(said, "lemma string, meaning_en string, meaning_zh string, sense_key string, rationale string")
    drops = spark.createDataFrame([(" Dropped ",), ("both",), ("",)], "lemma string")
    got = {r.lemma: r.violation for r in glosses.gloss_violations(candidates, said, drops).collect()}
    assert got == {
        "none": "undecided", "nomean": "no meaning", "nosense": "no sense", "norat": "no rationale", "sense": "another sense than the expansion's", "meaning": "another meaning than the expansion", "copied": "copied from another meaning",
        "both": "glossed and dropped", "twice": "decided twice", "extra": "unknown", "": "empty lemma",
    }


def test_batches(spark):
    batches = spark.createDataFrame([(1, 2), (2, 1), (3, 5)], "batch int, candidate_count int")
    candidates = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "batch int, lemma string")
    good = (glosses.VERSION, glosses.REVIEWER)
    results = lambda terms: spark.createDataFrame([(1, *good, terms, True), (2, glosses.VERSION, "someone", False, False), (3, *good, False, False)], "batch int, schema_version int, reviewer string, has_terminology boolean, has_explanations boolean")
    decisions = spark.createDataFrame([(1, "a", "gloss"), (1, "b", "drop"), (2, "a", "gloss"), (2, "b", "gloss"), (3, "d", "drop")], "batch int, lemma string, kind string")
    check = lambda terms: sorted((r.batch, r.lemma, r.violation) for r in glosses.batch_violations(batches, candidates, results(terms), decisions).collect() if r.lemma is None)
    rest = [(2, None, "identity of the result"), (3, None, "number of candidates")]
    assert check(True) == rest and check(False) == [(1, None, "no decisions on terms"), *rest]
    assert [(r.batch, r.lemma) for r in glosses.batch_violations(batches, candidates, results(True), decisions).where("lemma is not null").collect()] == [(2, "a")]
    assert tuple(glosses.merged_counts(batches, candidates, decisions).first()) == (3, 4, 3, 2)
