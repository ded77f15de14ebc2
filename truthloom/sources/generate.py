"""Synthetic claims of any size with known truth.

Properties are split into groups and sources dealt to the groups; a source is accurate on
its own group and poor elsewhere.  Every draw hashes the names involved, so the same call
gives the same table on any cluster, and nothing depends on partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from truthloom.functions.draws import draw, uniform
from truthloom.schema import CLAIM

# Fixed values of the data format: true values start at 100000 (399,999 of them), wrong
# values at 500000 (499,999 of them), and every item has 20 wrong values.
TRUE_START, TRUE_COUNT = 100000, 399999
FALSE_START, FALSE_COUNT = 500000, 499999
N_FALSE = 20

# Items of generated truth that one task takes.
ITEMS_PER_TASK = 20_000

# An answer plan (properties x sources) up to this many rows is broadcast.
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Accuracy:
    """m1: least accuracy of a matching group; m2: greatest elsewhere; m3: least coverage scale."""

    m1: float = 1.0
    m2: float = 0.0
    m3: float = 0.8


def named_range(spark: SparkSession, prefix: str, column: str, count: int) -> DataFrame:
    """``<column>`` = prefix1..prefixN and its dense zero-based ``<column>_idx``."""
    names = spark.range(count).withColumnRenamed("id", f"{column}_idx")
    return names.withColumn(column, F.concat(F.lit(prefix), F.col(f"{column}_idx") + 1))


def item_tasks(spark: SparkSession, n_items: int) -> int:
    """Tasks for so many generated items: work for all cores, and no more items than a task takes."""
    return max(spark.sparkContext.defaultParallelism, -(-n_items // ITEMS_PER_TASK))


def generate_truth(objects: DataFrame, properties: list[str], seed: str = "0", n_objects: int | None = None) -> DataFrame:
    """One true value and 20 distinct wrong values per (object, property).

    Objects are dealt to as many tasks as their number (counted if not given) asks for: what one task generates,
    and votes of it, does not grow with the data.

    Wrong values step through the 499,999 candidates by a constant stride.  499,999 is
    31 * 127 * 127, so no stride repeats within the first 31 steps.
    """
    n_objects = objects.count() if n_objects is None else n_objects
    tasks = item_tasks(objects.sparkSession, n_objects * len(properties))
    items = objects.repartition(tasks, "object").withColumn("property", F.explode(F.array(*[F.lit(p) for p in properties])))
    name = ["object", "property"]
    true_value = F.lit(TRUE_START) + F.pmod(draw(F.lit(seed), F.lit("true"), *map(F.col, name)), F.lit(TRUE_COUNT))
    start = F.pmod(draw(F.lit(seed), F.lit("start"), *map(F.col, name)), F.lit(FALSE_COUNT))
    stride = 1 + F.pmod(draw(F.lit(seed), F.lit("stride"), *map(F.col, name)), F.lit(FALSE_COUNT - 1))
    wrong = F.transform(
        F.sequence(F.lit(0), F.lit(N_FALSE - 1)),
        lambda j: (F.lit(FALSE_START) + F.pmod(F.col("start") + j * F.col("stride"), F.lit(FALSE_COUNT))).cast("string"),
    )
    drawn = items.select(
        *objects.columns, "property",
        true_value.cast("string").alias("value"), start.alias("start"), stride.alias("stride"),
    )
    return drawn.select(*objects.columns, "property", "value", wrong.alias("false_values"))


def split_properties(
    spark: SparkSession, properties: list[str], n_groups: int | None = None, seed: str = "0"
) -> DataFrame:
    """Deal the properties, in hashed order, to ``n_groups`` groups (drawn from 2..n-1 if not given).

    Result: property, group_id, place (position inside the group), group_size, n_groups.
    """
    count = len(properties)
    if n_groups is None:
        groups: Column = 2 + F.pmod(draw(seed, "groups"), F.lit(max(count - 2, 1)))
    else:
        groups = F.lit(n_groups).cast("bigint")
    shuffled = F.array_sort(
        F.array(*[F.struct(draw(seed, "deal", name).alias("draw"), F.lit(name).alias("property")) for name in properties])
    )
    dealt = spark.range(1).select(F.posexplode(shuffled).alias("rank", "entry"), groups.alias("n_groups"))
    group_id = F.pmod(F.col("rank"), F.col("n_groups"))
    size = F.floor((count - group_id - 1) / F.col("n_groups")) + 1
    return dealt.select(
        F.col("entry.property").alias("property"),
        group_id.cast("bigint").alias("group_id"),
        F.floor(F.col("rank") / F.col("n_groups")).cast("bigint").alias("place"),
        size.cast("bigint").alias("group_size"),
        F.col("n_groups").cast("bigint").alias("n_groups"),
    )


def assign_sources(sources: DataFrame, n_groups: Column | int) -> DataFrame:
    """Deal sources round-robin by ``source_idx``; the first one of each group leads it."""
    n = n_groups if isinstance(n_groups, Column) else F.lit(n_groups)
    return sources.withColumn("source_group", F.pmod(F.col("source_idx"), n)).withColumn(
        "is_lead", F.col("source_idx") < n
    )


def answer_plan(groups: DataFrame, sources: DataFrame, n_objects: int, accuracy: Accuracy, seed: str) -> DataFrame:
    """For each (property, source): how many leading items of the group are answered truly."""
    # One row per name in the caller's property list, so the table fits in a literal.
    dealt_rows = groups.orderBy("property").collect()
    literal = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in row.asDict().items()]) for row in dealt_rows])
    dealt = sources.select("source", "source_idx", F.inline(literal))
    dealt = assign_sources(dealt, F.col("n_groups"))
    base = F.when(
        F.col("group_id") == F.col("source_group"),
        uniform(accuracy.m1, 1.0, F.lit(seed), F.lit("base"), F.col("group_id"), F.col("source_group")),
    ).otherwise(uniform(0.0, accuracy.m2, F.lit(seed), F.lit("base"), F.col("group_id"), F.col("source_group")))
    own = uniform(F.col("base") - 0.5, F.col("base"), F.lit(seed), F.lit("own"), F.col("group_id"), F.col("source"))
    scale = uniform(accuracy.m3, 1.0, F.lit(seed), F.lit("scale"), F.col("group_id"), F.col("source"))
    items = F.col("group_size") * F.lit(n_objects)
    n_true = F.when(F.col("is_lead"), items * F.col("base")).otherwise(scale * items * own)
    return dealt.withColumn("base", base).select(
        "property", "place", "group_size", "source", "source_idx", n_true.alias("n_true")
    )


def generate_claims(
    truth: DataFrame,
    groups: DataFrame,
    sources: DataFrame,
    n_objects: int,
    accuracy: Accuracy = Accuracy(),
    seed: str = "0",
) -> DataFrame:
    """Every source answers every item: truly for its first items, wrongly for the others.

    ``truth`` comes from :func:`generate_truth` over objects with a dense ``object_idx``;
    items of a group are numbered by object, then by place of the property in the group.
    """
    plan = answer_plan(groups, sources, n_objects, accuracy, seed)
    n_plan = groups.count() * sources.count()
    if n_plan <= BROADCAST_ROWS:
        asked = truth.join(F.broadcast(plan), "property")
    else:
        # Few property names would mean few shuffle keys: cut the plan by source as well.
        cuts = -(-n_plan // BROADCAST_ROWS)
        # Objects are cut too, so a key holds a part of the objects and a part of the sources.
        slices = truth.sparkSession.sparkContext.defaultParallelism
        whole = truth.withColumn("slice", F.pmod(F.col("object_idx"), F.lit(slices)).cast("int"))
        asked = whole.withColumn("cut", F.explode(F.sequence(F.lit(0), F.lit(cuts - 1)))).join(
            plan.withColumn("cut", F.pmod(F.col("source_idx"), F.lit(cuts)).cast("int"))
            .withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))), ["property", "cut", "slice"]
        )
    position = F.col("object_idx") * F.col("group_size") + F.col("place")
    pick = F.pmod(draw(F.lit(seed), F.lit("wrong"), F.col("object"), F.col("property"), F.col("source")), F.lit(N_FALSE))
    wrong = F.element_at("false_values", (pick + 1).cast("int"))
    answer = F.when(position < F.col("n_true"), F.col("value")).otherwise(wrong)
    return asked.select("object", "property", answer.alias("value"), "source").select(*CLAIM)
