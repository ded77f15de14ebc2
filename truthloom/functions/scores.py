"""Scalar formulas of the trust models, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def trust_score(trust: Column) -> Column:
    """-ln(1 - t): how much one claim of a source with trust ``t`` counts."""
    return -F.log1p(-trust)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clamp_trust(trust: Column) -> Column:
    """Keep a trust strictly between 0 and 1 so that its logarithms exist."""
    return F.when(trust >= 1, F.lit(0.9999)).when(trust <= 0, F.lit(0.0001)).otherwise(trust)


def accuracy_log_odds(trust: Column, n: float) -> Column:
    """ln(n t / (1 - t)) for ``n`` equally likely wrong values per item."""
    positive = F.when(trust <= 0, F.lit(0.001)).otherwise(trust)
    return F.log(F.lit(float(n)) * positive / (1 - positive))


def dependence_posterior(
    trust: Column, kt: Column, kf: Column, kd: Column, c: float, n: float, alpha: float
) -> Column:
    """Probability that a source copies from another one.

    ``kt``/``kf`` count shared true/false values and ``kd`` different values.  The product
    of the three powers is summed as logarithms, and the exponent is held at 700 because
    exp() overflows a double soon after.
    """
    error = 1 - trust
    z = (
        F.lit(math.log((1 - alpha) / alpha))
        + kt * F.log((1 - error) / (1 - error + c * error))
        + kf * F.log(error / (c * n + error - c * error))
        + kd * F.lit(-math.log1p(-c))
    )
    return 1 / (1 + F.exp(F.least(z, F.lit(700.0))))


def tie_key(score: Column) -> Column:
    """Scores that agree to nine places count as tied."""
    return F.rint(score * F.lit(1e9))


# exp() of anything below 512 is far from the double limit, and a term 1024 below the
# largest one cannot change a double sum.
LOG_STEP = 512.0


def log_bucket(x: Column) -> Column:
    return F.floor(x / LOG_STEP)


def scaled_exp(x: Column) -> Column:
    """exp(x) relative to the lower edge of its bucket."""
    return F.exp(x - log_bucket(x) * LOG_STEP)


def log_of_buckets(buckets: Column) -> Column:
    """ln of the total of ``array<struct<bucket, mass>>`` made with :func:`scaled_exp`."""
    top = F.array_max(F.transform(buckets, lambda b: b["bucket"]))
    total = F.aggregate(
        buckets,
        F.lit(0.0),
        lambda acc, b: acc + b["mass"] * F.exp((b["bucket"] - top) * LOG_STEP),
    )
    return top * LOG_STEP + F.log(total)
