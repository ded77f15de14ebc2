"""The row at a given place in the order of its group, however large the group is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from truthloom.operators import skew
from truthloom.plans.workspace import Workspace


def at_positions(rows: DataFrame, keys: list[str], value: str, position: str, work: Workspace) -> DataFrame:
    """``rows`` whose zero-based place in the order of ``value`` within ``keys`` is in the column ``position``.

    Values are distinct within a group and ``position`` is the same in all its rows.  While no group can be too
    large for a task, places are numbered in a window.  Beyond that all rows are dealt in ranges of (keys, value),
    each range counts its rows per group, and the counts tell which range holds the wanted place and
    which place it is there: only rows of that range are ranked.
    """
    rows = work.keep(rows, "candidates")
    total = rows.count()
    if total <= skew.FLOOR:
        place = F.row_number().over(W.partitionBy(*keys).orderBy(value)) - 1
        return rows.withColumn("place", place).where(F.col("place") == F.col(position)).drop("place")
    ranges = -(-total // skew.FLOOR) + 1
    dealt = rows.repartitionByRange(ranges, *keys, value).withColumn("range", F.spark_partition_id())
    dealt = work.keep(dealt, "ranges")
    counts = dealt.groupBy(*keys, "range").agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("wanted"))
    earlier = W.partitionBy(*keys).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    placed = counts.withColumn("inside", F.col("wanted") - F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    held = placed.where((F.col("inside") >= 0) & (F.col("inside") < F.col("n"))).select(*keys, "range", "inside")
    place = F.row_number().over(W.partitionBy(*keys, "range").orderBy(value)) - 1
    near = dealt.join(held, [*keys, "range"]).withColumn("place", place)
    return near.where(F.col("place") == F.col("inside")).drop("place", "inside", "range")
