"""The truth matrix and the distance between properties.

The matrix has a row per property and a column per (object, source); a cell is 1 when the
source claims the value found for the item.  Only the 1 cells are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truthloom.operators.sets import SET, distinct_sets, pair_counts, set_members, units_with_sets
from truthloom.operators.skew import spread_join
from truthloom.plans.workspace import Workspace
from truthloom.schema import CLAIM, FACT, ITEM

CELL = ["object", "source"]


def truth_matrix(claims: DataFrame, found: DataFrame, hot_facts: DataFrame | None = None) -> DataFrame:
    """``property, object, source`` of the cells that hold 1."""
    joined = spread_join(claims.select(*CLAIM), found.select(*FACT), FACT, hot_facts, FACT, F.col("source"), "left_semi")
    return joined.select("property", *CELL)


def property_table(claims: DataFrame) -> DataFrame:
    """``property``: every name once."""
    return claims.select("property").distinct()


def property_names(claims: DataFrame, limit: int) -> list[str]:
    """The property names, sorted, if there are no more than ``limit``."""
    rows = property_table(claims).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} properties")
    return sorted(row.property for row in rows)


def property_distance(matrix: DataFrame, names: DataFrame, work: Workspace) -> DataFrame:
    """``p, q, d2``: squared Euclidean distance of every ordered pair of matrix rows.

    d2 = ones(p) + ones(q) - 2 * both(p, q).  Cells with the same set of properties are
    counted together, so pairs are formed per set, not per cell.  ``names`` has a row per property; the
    result has one per pair, so the rows of the names table are paired with each other.
    """
    matrix = work.keep(matrix, "matrix")
    cells = units_with_sets(matrix, CELL, "property")
    sets = work.keep(distinct_sets(cells, CELL), "cell-sets")
    members = work.keep(set_members(matrix, sets, CELL, "property"), "cell-properties")
    sets = sets.drop("unit")
    both = pair_counts(members, sets, "property", [])
    counted = members.join(sets, SET).groupBy("property").agg(F.sum("n").alias("ones"))
    ones = work.keep(names.join(counted, "property", "left").fillna(0, ["ones"]), "ones")
    ones_p = ones.select(F.col("property").alias("p"), F.col("ones").alias("ones_p"))
    ones_q = ones.select(F.col("property").alias("q"), F.col("ones").alias("ones_q"))
    shared = both.select(F.col("m1").alias("lo"), F.col("m2").alias("hi"), F.col("n").alias("both"))
    keyed = ones_p.crossJoin(ones_q).withColumns({"lo": F.least("p", "q"), "hi": F.greatest("p", "q")})
    joined = keyed.join(shared, ["lo", "hi"], "left").fillna(0, ["both"])
    d2 = F.when(F.col("p") == F.col("q"), F.lit(0)).otherwise(F.col("ones_p") + F.col("ones_q") - 2 * F.col("both"))
    return joined.select("p", "q", d2.cast("double").alias("d2"))
