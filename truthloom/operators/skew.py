"""Joins that stay balanced when one key holds a large share of the rows.

A key is *hot* when it holds more than FLOOR rows, what one task may well take, however large
the table.  Rows of a hot key are spread over several pieces by the hash of another column; the
other side of the join is repeated once per piece.  The list of hot keys is a table like any
other: Spark broadcasts it while it is small.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from truthloom.plans.workspace import Workspace

SHARE: int | None = None  # if set, also more than 1/SHARE of the table
FLOOR = 200_000
KEY_HASHES = 1 << 16  # at least so many are counted before the keys


def hot_keys(sizes: Callable[[], DataFrame], keys: list[str], size: str, total: int,
             share: int | None = None, floor: int | None = None) -> DataFrame | None:
    """``keys, pieces`` of the hot keys of a table of key sizes; ``None`` when there are none."""
    share = share or SHARE
    limit = max(floor or FLOOR, total // share if share else 0)
    if total <= limit:
        return None
    hot = sizes().where(F.col(size) > limit).select(
        *keys, F.ceil(F.col(size) / F.lit(limit)).cast("int").alias("pieces")
    )
    return None if hot.isEmpty() else hot


def busy_keys(rows: DataFrame, key: str, total: int, work: Workspace) -> DataFrame | None:
    """``key, pieces`` of the hot keys of ``rows`` where keys are too many to count each; ``None`` when there are none.

    Rows are counted by a hash of their key, and keys only where a hash holds as many rows as a hot key.
    """
    hashed = rows.select(key, F.pmod(F.xxhash64(key), F.lit(max(KEY_HASHES, 8 * total // FLOOR))).alias("hash")).where(F.col(key).isNotNull())
    full = hot_keys(lambda: hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("n")), ["hash"], "n", total)
    if full is None:
        return None
    found = hashed.join(work.keep(full, "hot-hashes"), "hash", "left_semi")
    hot = hot_keys(lambda: found.groupBy(key).agg(F.count(F.lit(1)).alias("n")), [key], "n", total)
    return None if hot is None else work.keep(hot, "hot-keys")


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], hot: DataFrame | None,
                hot_on: list[str], by: Column, how: str = "inner") -> DataFrame:
    """``big JOIN small`` on ``keys`` with the hot keys of ``big`` cut into pieces.

    ``hot_on`` names the columns of ``hot``; ``by`` is hashed to pick the piece of a row.
    """
    if hot is None:
        return big.join(small, keys, how)
    pieces = F.coalesce(F.col("pieces"), F.lit(1))
    cut = (
        big.join(hot, hot_on, "left")
        .withColumn("piece", F.pmod(F.xxhash64(by), pieces).cast("int"))
        .drop("pieces")
    )
    copies = (
        small.join(hot, hot_on, "left")
        .withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
        .drop("pieces")
    )
    return cut.join(copies, [*keys, "piece"], how).drop("piece")


def use_all_cores(df: DataFrame, *keys: str) -> DataFrame:
    """Spread the rows of an input with fewer partitions than cores by ``keys``.

    For small inputs ahead of much work per row, such as a file with a single row group.
    An input with enough partitions is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


# Members of one group that meet inside a single join key.
PAIR_CUT = 2048


def pair_join(left: DataFrame, right: DataFrame, keys: list[str], size: str, member: str,
              condition: Column, biggest: int | None = None, cut: int | None = None) -> DataFrame:
    """Self-join of group members, ``l`` and ``r``, for pairs that satisfy ``condition``.

    ``size`` names the column with the group size and ``biggest`` its maximum if known.

    Groups of more than ``cut`` members are cut into pieces and every pair of pieces gets a
    join key of its own, so no task meets more than ``cut`` x ``cut`` pairs of one group at
    a time.  The caller aggregates the pairs at once: they live only inside the join stage.
    """
    cut = cut or PAIR_CUT
    if biggest is None:
        biggest = right.agg(F.max(size)).first()[0] or 0
    if biggest <= cut:
        on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys]
    else:
        pieces = F.ceil(F.col(size) / F.lit(cut)).cast("int")
        own = F.pmod(F.xxhash64(member), pieces).cast("int")
        every = F.explode(F.sequence(F.lit(0), pieces - 1))
        left = left.withColumn("lp", own).withColumn("rp", every)
        right = right.withColumn("rp", own).withColumn("lp", every)
        on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in [*keys, "lp", "rp"]]
    for part in on[1:]:
        on[0] = on[0] & part
    return left.alias("l").join(right.alias("r"), on[0] & condition)
