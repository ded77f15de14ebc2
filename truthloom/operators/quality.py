"""Evaluation against ground truth, coverage and per-source statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from truthloom.operators.votes import vote_counts
from truthloom.schema import FACT, ITEM, as_truth


def confusion(claims: DataFrame, truth: DataFrame, found: DataFrame, group: list[str] = (), counted: bool = False) -> DataFrame:
    """Per-claim confusion counts; ``n_unmatched`` counts claims on items without truth or result.

    Only three numbers per item matter: all its votes, those for the true value and those for
    the found value.  Values meet the true and the found one of their item, so all joins and sums deal by
    item: vote counts that are dealt by item already are not shuffled.  ``claims`` may already be vote counts; ``found`` may hold
    several results told apart by ``group``, and with ``counted`` the ``votes`` for its values among ``claims``.
    """
    counts = claims if "votes" in claims.columns else vote_counts(claims)

    def supported(name: str) -> Column:
        return F.sum(F.when(F.col("value") == F.col(f"{name}_value"), F.col("votes")).otherwise(0)).alias(f"{name}_votes")

    def valued(values: DataFrame, name: str) -> DataFrame:
        return values.select(*ITEM, F.col("value").alias(f"{name}_value"))

    judged, names = counts.join(valued(as_truth(truth), "true"), ITEM, "left"), ["true"]
    if not group and not counted:
        judged, names = judged.join(valued(found, "found"), ITEM, "left"), ["true", "found"]
    joined = judged.groupBy(*ITEM, *[f"{name}_value" for name in names]).agg(
        F.sum("votes").alias("all_votes"), *[supported(name) for name in names]
    )
    if "found" not in names:
        chosen = found.select(*group, *FACT, "votes") if counted else (
            found.select(*group, *FACT).join(counts.select(*FACT, "votes"), FACT, "left").fillna(0, ["votes"]))
        joined = joined.join(chosen.withColumnsRenamed({"value": "found_value", "votes": "found_votes"}), ITEM, "left")
    matched = F.col("true_value").isNotNull() & F.col("found_value").isNotNull()
    right = F.col("true_value") == F.col("found_value")
    true_votes, found_votes, all_votes = F.col("true_votes"), F.col("found_votes"), F.col("all_votes")

    def total(condition: Column, votes: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, votes)), F.lit(0))

    others = F.when(right, all_votes - true_votes).otherwise(all_votes - true_votes - found_votes)
    return joined.groupBy(*group).agg(
        total(matched & right, true_votes).alias("tp"),
        total(matched & ~right, found_votes).alias("fp"),
        total(matched & ~right, true_votes).alias("fn"),
        total(matched, others).alias("tn"),
        total(~matched, all_votes).alias("n_unmatched"),
    )


def ratios(counts: DataFrame) -> DataFrame:
    """Add precision, recall, accuracy and F1 of class 1; 0 where a denominator is 0."""

    def ratio(over: Column, under: Column) -> Column:
        return F.coalesce(over / F.nullif(under.cast("double"), F.lit(0.0)), F.lit(0.0))

    tp, fp, fn, tn = (F.col(name) for name in ("tp", "fp", "fn", "tn"))
    return (
        counts.withColumn("precision", ratio(tp, tp + fp))
        .withColumn("recall", ratio(tp, tp + fn))
        .withColumn("accuracy", ratio(tp + tn, tp + fp + fn + tn))
        .withColumn("f1_score", ratio(2 * tp, 2 * tp + fp + fn))
    )


def evaluate(claims: DataFrame, truth: DataFrame, found: DataFrame) -> DataFrame:
    """One row: confusion counts, precision, recall, accuracy, F1."""
    return ratios(confusion(claims, truth, found))


def coverage(claims: DataFrame) -> DataFrame:
    """Share of the (source, property) slots of each object that hold a claim, over all objects."""
    slots = claims.groupBy("object").agg(
        F.count(F.lit(1)).alias("n_claims"), F.count_distinct("source").alias("n_sources"),
        F.count_distinct("property").alias("n_properties"),
    )
    total = F.sum(F.col("n_sources") * F.col("n_properties"))
    return slots.agg(
        F.count(F.lit(1)).alias("n_objects"),
        F.sum("n_claims").alias("n_claims"),
        total.alias("n_slots"),
        (1 - (total - F.sum("n_claims")) / total).alias("coverage"),
    )


def source_stats(claims: DataFrame) -> DataFrame:
    """Claims and objects per source."""
    counts = claims.groupBy("source").agg(F.count(F.lit(1)).alias("n_claims"))
    objects = claims.select("source", "object").distinct().groupBy("source").agg(F.count(F.lit(1)).alias("n_objects"))
    return counts.join(objects, "source")

