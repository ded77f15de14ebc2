"""Which sources copy from which: agreement counts and the dependence posterior."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from truthloom.functions.scores import accuracy_log_odds, dependence_posterior, tie_key
from truthloom.operators.skew import spread_join


def agreement(pairs: DataFrame, true_pairs: DataFrame, group: list[str]) -> DataFrame:
    """``group, s1, s2, kt, kf, kd`` for s1 < s2.

    ``pairs`` counts the items two sources share (``n_common``) and those on which they agree
    (``n_same``); ``true_pairs`` how many of the latter are true (``n_true``).  Only the
    last table changes from round to round.
    """
    joined = pairs.join(true_pairs, [*group, "s1", "s2"], "left").fillna(0, ["n_true"])
    return joined.select(
        *group, "s1", "s2",
        F.col("n_true").alias("kt"),
        (F.col("n_same") - F.col("n_true")).alias("kf"),
        (F.col("n_common") - F.col("n_same")).alias("kd"),
    )


def both_directions(pairs: DataFrame) -> DataFrame:
    """Counts are symmetric; list each pair as (s1, s2) and (s2, s1)."""
    ends = F.array(
        F.struct(F.col("s1").alias("s1"), F.col("s2").alias("s2")),
        F.struct(F.col("s2").alias("s1"), F.col("s1").alias("s2")),
    )
    rest = [c for c in pairs.columns if c not in ("s1", "s2")]
    return pairs.select(*rest, F.inline(ends)).select("s1", "s2", *rest)


def dependence(pairs: DataFrame, trust: DataFrame, group: list[str], c: float = 0.3, n: float = 100,
               alpha: float = 0.5, hubs: DataFrame | None = None) -> DataFrame:
    """Directed dependence ``dep`` of s1 on s2, judged by the error rate of s1.

    ``hubs`` (s1, pieces) names sources with more pairs than a task may take, here and below.
    """
    mine = trust.select(*group, F.col("source").alias("s1"), "trust")
    posterior = dependence_posterior(F.col("trust"), F.col("kt"), F.col("kf"), F.col("kd"), c, n, alpha)
    return (
        spread_join(both_directions(pairs), mine, [*group, "s1"], hubs, ["s1"], F.col("s2"))
        .select(*group, "s1", "s2", "kt", "kf", "kd", posterior.alias("dep"))
    )


def max_dependence(dep: DataFrame, group: list[str] = ()) -> DataFrame:
    return dep.groupBy(*group, F.col("s1").alias("source")).agg(F.max("dep").alias("max_dep"))


def ranked_before(dep: DataFrame, group: list[str], order: str, hubs: DataFrame | None = None) -> DataFrame:
    """Keep the rows of ``dep`` whose s2 ranks before s1.

    ``order="dependence"``: by greatest dependence, descending, then by name.
    ``order="name"``: by name.
    """
    if order == "name":
        return dep.where(F.col("s2") < F.col("s1"))
    if order != "dependence":
        raise ValueError(f"unknown source order {order!r}")
    most = max_dependence(dep, group)
    second = most.select(*group, F.col("source").alias("s2"), tie_key(F.col("max_dep")).alias("max2"))
    earlier = (F.col("max2") > F.col("max1")) | (
        (F.col("max2") == F.col("max1")) & (F.col("s2") < F.col("s1"))
    )
    if hubs is None:
        from_s1 = dep.withColumn("max1", tie_key(F.max("dep").over(W.partitionBy(*group, "s1"))))
    else:
        first = most.select(*group, F.col("source").alias("s1"), tie_key(F.col("max_dep")).alias("max1"))
        from_s1 = spread_join(dep, first, [*group, "s1"], hubs, ["s1"], F.col("s2"))
    to_s2 = None if hubs is None else hubs.withColumnRenamed("s1", "s2")
    return spread_join(from_s1, second, [*group, "s2"], to_s2, ["s2"], F.col("s1")).where(earlier).drop("max1", "max2")


def vote_factors(dep: DataFrame, trust: DataFrame, group: list[str], algo: str,
                 c: float, n: float, order: str, hubs: DataFrame | None = None) -> DataFrame:
    """``group, s1, s2, factor`` whose product over s2 is the discounted vote of s1.

    A predecessor s2 contributes 1 - c * dep(s1, s2); the row with s2 = s1 contributes the
    undiscounted vote: 1 for DEPEN, the log-odds of the source's trust for the others.
    Pairs that never agree never meet inside a value and are left out.
    """
    before = ranked_before(dep, group, order, hubs).where(F.col("kt") + F.col("kf") > 0)
    vote = F.lit(1.0) if algo == "DEPEN" else accuracy_log_odds(F.col("trust"), n)
    own = trust.select(*group, F.col("source").alias("s1"), F.col("source").alias("s2"), vote.alias("factor"))
    return before.select(*group, "s1", "s2", (1 - F.lit(float(c)) * F.col("dep")).alias("factor")).unionByName(own)
