"""Truth discovery on clusters of properties that are answered alike."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truthloom.operators.cluster import MAX_ITER, best_blocks
from truthloom.operators.matrix import property_distance, property_table, truth_matrix
from truthloom.operators.votes import best_values
from truthloom.plans.accuracy import depen
from truthloom.plans.claimbase import ClaimBase
from truthloom.schema import FACT, ITEM


@dataclass
class ClusteredResult:
    truths: DataFrame
    blocks: DataFrame
    trust: DataFrame
    rounds: int
    work: object


def matrix_distance(votes: DataFrame, one: DataFrame, other: DataFrame) -> float:
    """1 - cosine of the truth matrices of two results.

    A matrix has as many ones as its found values have votes, and the two share the votes
    of the items on which they agree; ``votes`` has ``object, property, value, votes``.
    """
    def chosen(found: DataFrame, name: str) -> DataFrame:
        return votes.join(found.select(*FACT), FACT).select(*ITEM, F.col("value").alias(name), F.col("votes").alias(f"{name}_votes"))

    both = chosen(one, "x").join(chosen(other, "y"), ITEM)
    cosine = F.sum(F.when(F.col("x") == F.col("y"), F.col("x_votes")).otherwise(0)) / (
        F.sqrt(F.sum("x_votes")) * F.sqrt(F.sum("y_votes"))
    )
    return 1.0 - both.agg(cosine.alias("cosine")).first().cosine


def clustered_truth(
    claims: DataFrame,
    model: Callable = depen,
    max_iter_part_check: int = 5,
    threshold: float = 1e-6,
    max_iter: int = MAX_ITER,
    k_max: int | None = None,
    starts: int | None = None,
    seed: str = "10",
    deduped: bool = False,
) -> ClusteredResult:
    """Vote, cluster the properties by their truth-matrix rows, resolve each cluster on its
    own, and repeat with the new truths.

    Stops when the partition comes back unchanged or when the matrix has moved less than
    ``threshold`` from the first one.  The seeds of the clustering are farthest-first, or drawn in several
    ``starts``.
    """
    base = ClaimBase.of(claims, deduped=deduped)
    work = base.work
    names = work.keep(property_table(base.facts), "names")
    votes = base.votes_per_value()
    truths = first = work.keep(best_values(votes).select(*FACT), "voted")
    partition, result, blocks, rounds = None, None, None, 0
    for _ in range(max_iter_part_check):
        matrix = truth_matrix(base.claims, truths, base.hot_facts)
        distances = work.keep(property_distance(matrix, names, work), "distances")
        blocks_now = work.keep(best_blocks(distances, names, work, max_iter, k_max, starts, seed), "blocks")
        partition_now = sorted((row.block_id, row.property) for row in blocks_now.collect())
        if partition is not None and (
            partition_now == partition or matrix_distance(votes, truths, first) < threshold
        ):
            break
        partition, blocks = partition_now, blocks_now
        result = model(base.with_blocks(blocks))
        truths = work.keep(result.truths.select(*FACT, "confidence", "block_id"), "truths")
        rounds += 1
    return ClusteredResult(truths, blocks, result.trust, rounds, work)
