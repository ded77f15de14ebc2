"""All ways to split the properties into blocks.

A partition is a list of labels, one per property in name order: the number of the property's block,
counted by first appearance.  Partitions are numbered in the order of these lists, and a number is turned
into its labels directly, so any range of partitions is a range of rows.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from truthloom.functions.scores import tie_key
from truthloom.plans.workspace import Workspace

#: Number of set partitions by number of properties: 5 -> 52, 8 -> 4140, 10 -> 115975, 12 -> 4213597.
MAX_PROPERTIES = 12
#: Beyond this the numbers of partitions don't fit into 64 bits.
MOST_PROPERTIES = 25


@cache
def completions(left: int, used: int) -> int:
    """Ways to label ``left`` more properties when ``used`` blocks are in use."""
    return 1 if left == 0 else used * completions(left - 1, used) + completions(left - 1, used + 1)


def labels_of(number: str, n: int) -> Column:
    """The labels of the partition with the number in the column ``number``.

    With m blocks in use and k properties to come, each of the labels 0..m-1 leaves the same number of
    completions; the new label m follows them.
    """
    ways = ", ".join(f"array({', '.join(f'{completions(n - 1 - at, used)}L' for used in range(at + 1))})" for at in range(n))
    label = f"cast(least(s.rest div array({ways})[at][s.used], s.used) as int)"
    return F.expr(f"""aggregate(sequence(0, {n - 1}),
  named_struct('labels', cast(array() as array<int>), 'rest', cast({number} as bigint), 'used', 0),
  (s, at) -> named_struct('labels', array_append(s.labels, {label}),
    'rest', s.rest - {label} * array({ways})[at][s.used], 'used', greatest(s.used, {label} + 1)),
  s -> s.labels)""")


def partition_ids(labels: Column, n: int) -> Column:
    """The labels as text, with zeros in front so that ids sort like labels."""
    width = len(str(max(n - 1, 0)))
    digits = F.transform(labels, lambda label: F.lpad(label.cast("string"), width, "0"))
    return F.array_join(digits, "" if width == 1 else "-")


def partitions_at(numbers: DataFrame, properties: list[str]) -> DataFrame:
    """``number, partition_id, property, label`` of the partitions with the numbers in the column ``id``."""
    names = sorted(properties)
    named = numbers.select(F.col("id").alias("number"), labels_of("id", len(names)).alias("labels"))
    pairs = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("property"), F.col("labels").alias("label"))
    return named.select("number", partition_ids(F.col("labels"), len(names)).alias("partition_id"), F.inline(pairs)).toDF(
        "number", "partition_id", "property", "label")


def set_partitions(spark: SparkSession, properties: list[str], limit: int | None = None,
                   max_properties: int = MAX_PROPERTIES) -> DataFrame:
    """``partition_id, property, label``: one row per partition and property.

    ``limit`` keeps so many partitions in id order; no others are formed, so it also works beyond ``max_properties``.
    """
    n = len(properties)
    if n > MOST_PROPERTIES or (limit is None and n > max_properties):
        raise ValueError(f"{n} properties: more than {max_properties} give too many partitions")
    end = completions(n, 0) if limit is None else min(completions(n, 0), limit)
    return partitions_at(spark.range(end), properties).drop("number")


def partition_blocks(partitions: DataFrame, properties: list[str]) -> DataFrame:
    """``partition_id, block_id, block``; equal blocks of different partitions share the id.

    Bit i of the block id tells whether the i-th property by name is in the block.
    """
    bits = {name: 1 << i for i, name in enumerate(sorted(properties))}
    bit = F.element_at(F.create_map(*[F.lit(x) for pair in bits.items() for x in pair]), F.col("property"))
    return partitions.groupBy("partition_id", "label").agg(
        F.sum(bit).alias("block_id"), F.array_sort(F.collect_list("property")).alias("block")
    ).select("partition_id", "block_id", "block")


def partition_lists(blocks: DataFrame) -> DataFrame:
    """``partition_id, partition``: sorted blocks of sorted properties."""
    return blocks.groupBy("partition_id").agg(F.array_sort(F.collect_list("block")).alias("partition"))


# --- the best partition without listing all of them ---

#: What is made as great as possible: the mean or the greatest of a number per block, or its sum.
AIMS = ("mean", "greatest", "sum")


def subset_splits(spark: SparkSession, n: int) -> DataFrame:
    """``whole, first, rest, size``: each non-empty subset, cut into a block with its first property and the rest.

    (3^n - 1) / 2 rows of bit masks: a subset of p properties has 2^(p-1) such blocks, and the bits of a number
    below 2^(p-1) choose one.
    """
    bits = F.expr(f"filter(sequence(0, {n - 1}), i -> (id & shiftleft(1L, i)) > 0)")
    chosen = F.expr("explode(sequence(0L, shiftleft(1L, size(bits) - 1) - 1))")
    first = F.expr("""aggregate(sequence(0, size(bits) - 1), 0L, (mask, j) ->
  if(j = 0 or (chosen & shiftleft(1L, greatest(j - 1, 0))) > 0, mask | shiftleft(1L, bits[j]), mask))""")
    wholes = spark.range(1, 1 << n).select(F.col("id").alias("whole"), bits.alias("bits"))
    cut = wholes.select("whole", "bits", chosen.alias("chosen")).select("whole", F.size("bits").alias("size"), first.alias("first"))
    return cut.withColumn("rest", F.col("whole") - F.col("first"))


def best_partition_of(scores: DataFrame, n: int, work: Workspace, aim: str = "mean") -> DataFrame:
    """One row ``partition_id, labels, n_blocks, value``: the partition of n properties with the best blocks.

    ``scores`` has ``block_id, score`` for every non-empty subset; bit i of the id stands for property i.
    ``aim`` says what of the blocks' scores is to be as great as possible; equal values (to nine places)
    go to the smallest partition id.

    A dynamic programme over subsets, by size: the best way to split a subset is a block with its
    first property and the best way to split the rest.  For the mean, the best sum is kept for every
    number of blocks.  3^n / 2 merges replace the list of all partitions, whose number is Bell(n).
    """
    if aim not in AIMS:
        raise ValueError(f"unknown aim {aim!r}")
    if not 1 <= n <= MOST_PROPERTIES:
        raise ValueError(f"{n} properties cannot be searched")
    blocks = scores.select(F.col("block_id").cast("bigint").alias("first"), F.col("score").cast("double").alias("score"))
    splits = work.keep(subset_splits(scores.sparkSession, n).join(blocks, "first"), "splits")
    places = F.sequence(F.lit(0), F.lit(n - 1))

    def in_mask(mask: str):
        return lambda i: F.col(mask).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), i)) > 0

    alone = F.transform(places, lambda i: F.when(in_mask("whole")(i), F.lit(0)).otherwise(F.lit(-1)))
    single = splits.where("rest = 0").select("whole", "size", F.lit(1).alias("n_blocks"), F.col("score").alias("total"), alone.alias("labels"))
    known: DataFrame | None = None
    for size in range(1, n + 1):
        found = single.where(F.col("size") == size).drop("size")
        if known is not None:
            held = known.withColumnsRenamed({"whole": "rest", "n_blocks": "n_rest", "total": "of_rest", "labels": "labels_rest"})
            joined = splits.where((F.col("size") == size) & (F.col("rest") > 0)).join(held, "rest")
            total, lower = F.col("score") + F.col("of_rest"), F.col("labels_rest")
            if aim == "greatest":
                total = F.greatest("score", "of_rest")
                # the rest decides nothing: its smallest labels are those of one block
                plain = F.transform(F.col("labels_rest"), lambda label: F.least(label, F.lit(0)))
                lower = F.when(tie_key(F.col("score")) >= tie_key(F.col("of_rest")), plain).otherwise(F.col("labels_rest"))
            labels = F.transform(lower, lambda label, i: F.when(in_mask("first")(i), F.lit(0)).when(label >= 0, label + 1).otherwise(F.lit(-1)))
            found = found.unionByName(joined.select("whole", (F.col("n_rest") + 1).alias("n_blocks"), total.alias("total"), labels.alias("labels")))
        keys = ["whole", "n_blocks"] if aim == "mean" else ["whole"]
        best = F.min(F.struct((-tie_key(F.col("total"))).alias("below"), "labels", "n_blocks", "total")).alias("best")
        chosen = found.groupBy(*keys).agg(best).select("whole", "best.n_blocks", "best.total", "best.labels")
        level = work.keep(chosen, f"subsets-{size}")
        known = level if known is None else known.unionByName(level)
    value = F.col("total") / F.col("n_blocks") if aim == "mean" else F.col("total")
    whole = level.select(partition_ids(F.col("labels"), n).alias("partition_id"), "labels", F.array_max("labels").alias("last"), value.alias("value"))
    won = F.min(F.struct((-tie_key(F.col("value"))).alias("below"), "partition_id", "labels", "last", "value")).alias("won")
    return whole.agg(won).select("won.partition_id", "won.labels", (F.col("won.last") + 1).alias("n_blocks"), "won.value")
