"""Vote counts and the winning value of each item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truthloom.functions.draws import seeded_index
from truthloom.operators.selection import at_positions
from truthloom.operators.skew import hot_keys, spread_join
from truthloom.plans.workspace import Workspace
from truthloom.schema import FACT, ITEM


def vote_counts(claims: DataFrame) -> DataFrame:
    """Claims per (item, value); repeated claims of one source count again."""
    return claims.groupBy(*FACT).agg(F.count(F.lit(1)).alias("votes"))


def _hot_items(scored: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame | None]:
    """The scores as a table, and its items with more values than a task may take."""
    scored = work.keep(scored, "scores")
    sizes = scored.groupBy(*ITEM).agg(F.count(F.lit(1)).alias("n_values"))
    return scored, hot_keys(lambda: sizes, ITEM, "n_values", scored.count())


def tied_values(scored: DataFrame, score: str = "votes", work: Workspace | None = None) -> DataFrame:
    """One row per value that reaches the top score of its item, with the tie size.

    Ties are rows, not an array: an item may have any number of tied values.
    """
    scored, hot = _hot_items(scored.select(*FACT, score), work or Workspace(scored.sparkSession))
    top = scored.groupBy(*ITEM).agg(F.max(score).alias("top"))
    tied = spread_join(scored, top, ITEM, hot, ITEM, F.col("value")).where(F.col(score) == F.col("top"))
    size = tied.groupBy(*ITEM).agg(F.count(F.lit(1)).alias("n_tied"))
    return spread_join(tied, size, ITEM, hot, ITEM, F.col("value")).select(*FACT, score, "n_tied")


def best_values(scored: DataFrame, score: str = "votes", tie: str = "min", seed: int = 10) -> DataFrame:
    """One value per item with the highest score.

    ``tie="min"`` takes the smallest tied value.  ``tie="seeded"`` takes the position that
    Python's ``random.choice`` would pick in the sorted tie list after seeding with ``seed``.
    """
    if tie == "min":
        best = F.min(F.struct((-F.col(score)).alias("below"), "value")).alias("best")
        won = scored.groupBy(*ITEM).agg(best)
        return won.select(*ITEM, F.col("best.value").alias("value"), (-F.col("best.below")).alias(score))
    if tie != "seeded":
        raise ValueError(f"unknown tie policy {tie!r}")
    work = Workspace(scored.sparkSession)
    tied = tied_values(scored, score, work).withColumn("pick", seeded_index(F.col("n_tied"), seed))
    return at_positions(tied, ITEM, "value", "pick", work).select(*FACT, score)


def majority_vote(claims: DataFrame, tie: str = "min", seed: int = 10) -> DataFrame:
    """``object, property, value, votes``: the value most sources claim."""
    return best_values(vote_counts(claims), "votes", tie, seed)


def restrict_properties(df: DataFrame, properties: DataFrame | list[str]) -> DataFrame:
    """Rows whose property is in a list or in the ``property`` column of a table."""
    if isinstance(properties, DataFrame):
        return df.join(properties.select("property"), "property", "left_semi")
    return df.where(F.col("property").isin(list(properties)))
