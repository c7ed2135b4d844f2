"""Scalar functions of the word-knowledge model and of display rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The model's constants.
CEFR = {"A1": 0.8, "A2": 0.6, "B1": 0.35, "B2": 0.15}
EXAM = {"gk": 0.3, "cet4": 0.2, "cet6": 0.1}
TARGETS = (0.93, 0.78, 0.63, 0.48, 0.33, 0.18)
GRID, LOW, STEPS, PRIOR_SD = 801, -5, 80, 1.5
UNKNOWN, MARGIN = 0.3, 0.05


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x))))


def logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(q / (1 - q))


def frequency_prior(lemma: Column, zipf: Column) -> Column:
    return sigmoid(1.55 * (zipf - 3.65) - 0.075 * F.greatest(F.length(lemma) - 7, F.lit(0)))


def education_adjustment(level: Column, tags: Column) -> Column:
    """The larger of a level's and the best exam tag's adjustment, 0 without either."""
    cefr = F.lit(0.0)
    for k, v in CEFR.items():
        cefr = F.when(level == k, v).otherwise(cefr)
    exam = [F.when(F.array_contains(F.coalesce(tags, F.array().cast("array<string>")), k), v).otherwise(0.0) for k, v in EXAM.items()]
    return F.greatest(cefr, *exam)


def importance_tier(documents: Column) -> Column:
    return F.when(documents >= 10, "A").when(documents >= 5, "B").when(documents >= 3, "C").otherwise("D")


def classification(p: Column, documents: Column, threshold: float) -> Column:
    """Of a probability known: important words just above the threshold are kept as boundary cases."""
    protected = importance_tier(documents).isin("A", "B") & (p >= threshold) & (p < min(1.0, threshold + MARGIN))
    return F.when(protected, "important_boundary").when(p >= threshold, "likely_known").when(p <= UNKNOWN, "likely_unknown").otherwise("uncertain")


def half_up(x: Column, digits: int = 0) -> Column:
    """floor(x * 10^digits + 1/2) / 10^digits."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def percent(x: Column) -> Column:
    """A share as text with one decimal, halves up."""
    return F.concat(F.format_string("%.1f", (F.floor(x * 1000 + 0.5) / 10).cast("double")), F.lit("%"))


def dispersion(total: Column, squares: Column, n: Column) -> Column:
    """Juilland's D over n documents from sum and sum of squares of counts; documents without the word count as zeros."""
    mean = total / n
    sd = F.sqrt(F.greatest(squares / n - mean * mean, F.lit(0.0)))
    d = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - sd / mean / F.sqrt(n - 1)))
    return F.when(total == 0, 0.0).when(n <= 1, 1.0).otherwise(d)
