"""Which words a reader knows: grid posterior of ability, predictions, classes, next question.

The ability grid is a fixed 801 points and a session has at most some dozen answers, so
their product is a small table; words meet only its two moments, one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import model


def enriched(words: DataFrame) -> DataFrame:
    """words (lemma, zipf, cefr_level, exam_tags, ...) with prior columns."""
    base = model.frequency_prior(F.col("lemma"), F.col("zipf"))
    out = words.withColumns({"frequency_prior_probability": base, "education_adjustment": model.education_adjustment(F.col("cefr_level"), F.col("exam_tags"))})
    return out.withColumn("prior_probability", model.sigmoid(model.logit(F.col("frequency_prior_probability")) + F.col("education_adjustment")))


def posterior(words: DataFrame, answers: DataFrame) -> DataFrame:
    """theta and weight over the grid, from answers (lemma, response); `unsure` tells nothing."""
    spark = words.sparkSession
    grid = spark.range(model.GRID).select((model.LOW + F.col("id") / model.STEPS).alias("theta"))
    told = answers.where(F.col("response").isin("known", "unknown")).join(words.select("lemma", "prior_probability"), "lemma")
    told = told.select(model.logit(F.col("prior_probability")).alias("_l"), (F.col("response") == "known").alias("_k"))
    p = model.sigmoid(F.col("_l") + F.col("theta"))
    likelihood = F.log(F.greatest(F.lit(1e-12), F.when(F.col("_k"), p).otherwise(1 - p)))
    sums = grid.join(F.broadcast(told), how="left").groupBy("theta").agg(F.coalesce(F.sum(likelihood), F.lit(0.0)).alias("_log"))  # answers: some dozen
    prior = -0.5 * F.pow(F.col("theta") / model.PRIOR_SD, 2)
    logs = sums.withColumn("_log", F.col("_log") + prior)
    whole = Window.partitionBy()
    raw = logs.withColumn("_raw", F.exp(F.col("_log") - F.max("_log").over(whole)))
    return raw.select("theta", (F.col("_raw") / F.sum("_raw").over(whole)).alias("weight"))


def moments(weights: DataFrame) -> DataFrame:
    """One row: mean and variance of ability."""
    mean = F.sum(F.col("theta") * F.col("weight"))
    return weights.agg(mean.alias("theta_mean"), (F.sum(F.col("theta") * F.col("theta") * F.col("weight")) - mean * mean).alias("theta_variance"))


def percentiles(weights: DataFrame, targets: tuple[float, ...] = (0.05, 0.95)) -> DataFrame:
    """One row: for each target the first theta at which the running weight reaches it."""
    running = weights.withColumn("_c", F.sum("weight").over(Window.orderBy("theta").rowsBetween(Window.unboundedPreceding, 0)))
    return running.agg(*[F.coalesce(F.min(F.when(F.col("_c") >= t, F.col("theta"))), F.max("theta")).alias(f"p{round(t * 100):02d}") for t in targets])


def predicted(words: DataFrame, answers: DataFrame, weights: DataFrame) -> DataFrame:
    """words with probability_known: the logistic-normal approximation; direct answers are 1 or 0."""
    scale = F.sqrt(1 + F.lit(3.141592653589793) * F.col("theta_variance") / 8)
    own = answers.select("lemma", F.col("response").alias("direct_response"))
    out = words.crossJoin(F.broadcast(moments(weights))).join(F.broadcast(own), "lemma", "left")  # one row; some dozen
    p = model.sigmoid((model.logit(F.col("prior_probability")) + F.col("theta_mean")) / scale)
    p = F.when(F.col("direct_response") == "known", 1.0).when(F.col("direct_response") == "unknown", 0.0).otherwise(p)
    return out.withColumn("probability_known", p).drop("theta_mean", "theta_variance")


def calibrated(words: DataFrame, answers: DataFrame, threshold: float = 0.9) -> DataFrame:
    """words with probability_known, classification, importance_tier and their protection."""
    out = predicted(words, answers, posterior(words, answers))
    kind = model.classification(F.col("probability_known"), F.col("document_count"), threshold)
    out = out.withColumns({"classification": kind, "importance_tier": model.importance_tier(F.col("document_count")), "selected_threshold": F.lit(threshold)})
    return out.withColumn("important_boundary_protected", F.col("classification") == "important_boundary")


def next_question(words: DataFrame, answers: DataFrame, asked: int, limit: int = 30) -> DataFrame:
    """The word to ask next, at most one row: near fixed targets first, then the most telling; ties by input_pos."""
    rest = words.join(F.broadcast(answers.select("lemma")), "lemma", "left_anti")  # some dozen
    if asked >= limit:
        return rest.limit(0).select("lemma", F.lit(0.0).alias("score"))
    if asked < len(model.TARGETS):
        gap = F.abs(F.col("prior_probability") - model.TARGETS[asked])
        return rest.orderBy(gap, F.desc("document_count"), F.desc("total_count"), "input_pos").limit(1).select("lemma", gap.alias("score"))
    p = F.col("probability_known")
    pos = answers.join(words.select("lemma", "part_of_speech"), "lemma").groupBy("part_of_speech").agg(F.count(F.lit(1)).alias("_asked"))
    most = words.agg(F.max("document_count").alias("_most"))
    told = predicted(words, answers, posterior(words, answers)).join(rest.select("lemma"), "lemma", "left_semi")
    told = told.join(F.broadcast(pos), "part_of_speech", "left").crossJoin(F.broadcast(most))  # a row per part of speech; one row
    score = p * (1 - p) * (0.8 + 0.2 * F.col("document_count") / F.col("_most")) / (1 + 0.08 * F.coalesce("_asked", F.lit(0)))
    return told.withColumn("score", score).orderBy(F.desc("score"), "input_pos").limit(1).select("lemma", "score")


def boundary_lists(rows: DataFrame, threshold: float = 0.9, most: int = 30) -> DataFrame:
    """The lowest known words and the words nearest to the threshold: list, lemma, probability_known."""
    known = rows.where("classification = 'likely_known'").orderBy("probability_known", "lemma").limit(most)
    near = rows.orderBy(F.abs(F.col("probability_known") - threshold), "lemma").limit(most)
    return known.select(F.lit("lowest_known").alias("list"), "lemma", "probability_known").union(near.select(F.lit("near_threshold"), "lemma", "probability_known"))


def mastery(rows: DataFrame, mastered: DataFrame) -> DataFrame:
    """Share mastered of words to learn, for tiers A and B and for C and D; mastered: form."""
    own = rows.where("classification <> 'likely_known'").join(mastered.select(F.lower("form").alias("_form")).distinct(), F.lower("lemma") == F.col("_form"), "left")
    hit = (F.col("classification") == "important_boundary") | F.col("_form").isNotNull()
    by = own.groupBy(F.when(F.col("importance_tier").isin("A", "B"), "priority").otherwise("other").alias("key"))
    out = by.agg(F.count_if(hit).alias("mastered_count"), F.count(F.lit(1)).alias("total_count"))
    return out.withColumn("mastery_percent", F.round(F.col("mastered_count") / F.col("total_count") * 100, 1))
