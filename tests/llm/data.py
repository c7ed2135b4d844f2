"""Small awkward tables: nulls, empty and long texts, repeats, ties, extra and clashing columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(n))


def documents(spark, n=60, seed=1, extra=True):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = words(rng, rng.choice((0, 1, 3, 5, 40, 120)))
        if i % 9 == 4:
            text += "\n\n" + words(rng, 30) + "\t#é!  ß"
        rows.append((i * 3, text, rng.choice(("en", "fr", None)), rng.choice(("b", "a", "a", "a", None)), len(text)))
    rows[5] = (15, None, None, None, None)
    rows[6] = (18, "", "en", "a", 0)
    rows[7] = (21, words(rng, 9000), "en", "a", 1)
    rows[8] = (24, rows[9][1], "fr", "b", 1)  # a copy
    rows[10] = (30, rows[7][1].replace("a", "A", 40), "en", "a", 1)  # the same words
    rows[11] = (33, rows[7][1] + " tail of it", "en", "c", 1)  # a near copy
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    if not extra:
        return df
    from pyspark.sql import functions as F

    # columns whose names are also those of the operators
    return df.withColumns({"score": F.lit(7), "start": F.lit("s"), "size": F.lit(None).cast("int"), "n": F.lit(1), "rank": F.lit(2), "held_out": F.lit("x")})


def empty(spark):
    return spark.createDataFrame([], DOCS)
