"""Counting pairs of members that share a unit, without listing the pairs of every unit.

A *unit* (a data item, a claimed value, a cell of the truth matrix) has a set of members
(its sources, its properties).  Units with the same member set contribute the same pairs,
so each distinct set is kept once with the number of units that have it, and pairs are
formed per distinct set.  When sources cover everything there is a single set, however many
items there are; with few sources the number of sets stops growing with the data.

A set is identified by its size and two 64-bit XOR sums of member hashes.  XOR sums are
ordinary partial aggregates: no member list of any group is ever collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from truthloom.operators.skew import pair_join, spread_join

SET = ["set_hi", "set_lo", "set_size"]


def set_key(member: str) -> list[Column]:
    """Aggregates that identify the set of ``member`` values of a group without duplicates."""
    return [
        F.bit_xor(F.xxhash64(member)).alias("set_hi"),
        F.bit_xor(F.xxhash64(F.lit("second"), member)).alias("set_lo"),
        F.count(F.lit(1)).alias("set_size"),
    ]


def units_with_sets(memberships: DataFrame, unit: list[str], member: str) -> DataFrame:
    return memberships.groupBy(*unit).agg(*set_key(member))


def distinct_sets(units: DataFrame, unit: list[str]) -> DataFrame:
    """``SET, unit, n``: each distinct set, one unit that has it, and how many units do.

    The smallest unit is taken, not just any: a recomputed task must choose the same one.
    """
    return units.groupBy(*SET).agg(F.min(F.struct(*unit)).alias("unit"), F.count(F.lit(1)).alias("n"))


def set_members(memberships: DataFrame, sets: DataFrame, unit: list[str], member: str,
                hot: DataFrame | None = None) -> DataFrame:
    """``SET, member``: the members of each distinct set, read off its unit."""
    chosen = sets.select(*SET, "unit.*")
    return spread_join(memberships, chosen, unit, hot, unit, F.col(member)).select(*SET, member)


def pair_counts(members: DataFrame, weights: DataFrame, member: str, group: list[str],
                hot_sets: DataFrame | None = None, biggest: int | None = None) -> DataFrame:
    """``group, m1, m2, n`` for m1 < m2: total weight of the sets that hold both members.

    ``weights`` has ``group, SET, n``.  The pairs are summed as they leave the join.
    """
    left = spread_join(members, weights, SET, hot_sets, SET, F.col(member))
    smaller_first = F.col(f"l.{member}") < F.col(f"r.{member}")
    pairs = pair_join(left, members, SET, "set_size", member, smaller_first, biggest)
    keys = [F.col(f"l.{g}").alias(g) for g in group]
    return pairs.groupBy(*keys, F.col(f"l.{member}").alias("m1"), F.col(f"r.{member}").alias("m2")).agg(
        F.sum("l.n").alias("n")
    )
