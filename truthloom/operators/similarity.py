"""Similarity of the values claimed for one item, and its effect on their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from truthloom.functions.text import char_weights, number_of, numeric_similarity, weights_dot
from truthloom.operators.skew import hot_keys, pair_join, spread_join
from truthloom.plans.workspace import Workspace
from truthloom.schema import FACT, ITEM

KINDS = ("char", "numeric")


def _with_size(values: DataFrame, keys: list[str]) -> DataFrame:
    """Values with the number of values of their item; items with very many are spread.

    ``values`` is a written table: it is read three times.
    """
    size = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_values"))
    hot = hot_keys(lambda: size, keys, "n_values", values.count())
    return spread_join(values, size, keys, hot, keys, F.col("value"))


def value_similarity(claims: DataFrame, kind: str = "char", work: Workspace | None = None) -> DataFrame:
    """``object, property, v1, v2, sim`` for all ordered pairs of distinct values of an item.

    This table is quadratic in the values of an item by definition.  The models below do
    not use it: see :func:`implied_scores`.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown similarity {kind!r}")
    values = claims.select(*FACT).distinct()
    if kind == "char":
        values = values.withColumn("feature", char_weights(F.col("value")))
        sim = weights_dot(F.col("l.feature"), F.map_from_entries(F.col("r.feature")))
    else:
        values = values.withColumn("feature", number_of(F.col("value")))
        sim = numeric_similarity(F.col("l.feature"), F.col("r.feature"))
    values = (work or Workspace(claims.sparkSession)).keep(values, "values")
    sized = _with_size(values, ITEM)
    half = pair_join(sized, sized, ITEM, "n_values", "value", F.col("l.value") < F.col("r.value")).select(
        "l.object", "l.property", F.col("l.value").alias("a"), F.col("r.value").alias("b"), sim.alias("sim")
    )
    both = F.array(F.struct(F.col("a").alias("v1"), F.col("b").alias("v2")),
                   F.struct(F.col("b").alias("v1"), F.col("a").alias("v2")))
    return half.select(*ITEM, F.inline(both), "sim").select(*ITEM, "v1", "v2", "sim")


def _implied_in_place(scored: DataFrame, rho: float, keys: list[str]) -> DataFrame:
    """Character similarity for facts dealt by ``group_id``: windows and groups that need no shuffle."""
    rest = [c for c in scored.columns if c != "weights"]
    spelled = scored.select(*rest, F.inline_outer("weights"))
    item_weight = F.sum(F.col("w") * F.col("score")).over(W.partitionBy("item_hash", "group_id", *keys, "ch"))
    dots = spelled.withColumn("dot", F.col("w") * item_weight).groupBy(*rest).agg(F.sum("dot").alias("dot"))
    others = F.col("dot") - F.when(F.length("value") > 0, F.col("score")).otherwise(0.0)
    boosted = F.when(F.col("dot").isNull(), F.col("score")).otherwise(F.col("score") + rho * others)
    return dots.withColumn("score", boosted).drop("dot")


def implied_scores(scored: DataFrame, rho: float, kind: str, group: list[str] = (),
                   hot_items: DataFrame | None = None, biggest: int | None = None) -> DataFrame:
    """Add to each score ``rho`` times the similarity-weighted scores of the item's other values.

    ``scored`` has ``group, object, property, value, score`` and keeps its other columns; for
    numeric similarity it is read several times and should be a written table.  A column ``weights`` with the character weights of the value is used and dropped.

    Character similarity is a dot product of unit vectors, so the sum over the other values
    is the dot product with one vector per item, the score-weighted sum of all its value
    vectors, less the value's own share.  No pair of values is ever formed; the item vector
    has at most one entry per distinct character.  Numeric similarity has no such form: its
    pairs are summed within the join stage, and ``biggest`` is the greatest number of values
    of an item, if known.
    """
    keys = [*group, *ITEM]
    if kind == "char":
        if "weights" not in scored.columns:
            scored = scored.withColumn("weights", char_weights(F.col("value")))
        if "group_id" in scored.columns:
            return _implied_in_place(scored, rho, keys)
        weighted = scored.select(*keys, "score", F.inline("weights"))
        by_char = weighted.groupBy(*keys, "ch").agg(F.sum(F.col("w") * F.col("score")).alias("w"))
        vector = by_char.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("ch", "w"))).alias("vector"))
        joined = spread_join(scored, vector, keys, hot_items, ITEM, F.col("value"), "left")
        others = weights_dot(F.col("weights"), F.col("vector")) - F.when(
            F.length("value") > 0, F.col("score")
        ).otherwise(0.0)
        boosted = F.when(F.col("vector").isNull(), F.col("score")).otherwise(F.col("score") + rho * others)
        return joined.withColumn("score", boosted).drop("vector", "weights")
    if kind != "numeric":
        raise ValueError(f"unknown similarity {kind!r}")
    numbers = _with_size(scored.select(*keys, "value", "score", number_of(F.col("value")).alias("x")), keys)
    gap = numeric_similarity(F.col("l.x"), F.col("r.x"))
    sums = (
        pair_join(numbers, numbers, keys, "n_values", "value", F.col("l.value") != F.col("r.value"), biggest)
        .groupBy(*[F.col(f"l.{k}").alias(k) for k in keys], F.col("l.value").alias("value"))
        .agg(F.sum(F.col("r.score") * gap).alias("others"))
    )
    joined = scored.join(sums, [*keys, "value"], "left")
    return joined.withColumn("score", F.col("score") + rho * F.coalesce("others", F.lit(0.0))).drop("others")
