"""Search over all partitions of the properties."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from truthloom.operators.matrix import property_names
from truthloom.operators.partitions import (
    MAX_PROPERTIES, MOST_PROPERTIES, best_partition_of, completions, partition_blocks, partition_lists, partitions_at, set_partitions,
)
from truthloom.operators.quality import confusion, ratios
from truthloom.plans.accuracy import depen
from truthloom.plans.claimbase import ClaimBase

COUNTS = ["tp", "fp", "fn", "tn", "n_unmatched"]
METRICS = ["precision", "recall", "accuracy", "f1_score"]
REPORT = ["partition_id", "partition", "n_blocks", "accuracy_max", "accuracy_avg", *COUNTS, *METRICS]
#: What the best partition is best in: the mean or the greatest block trust, or the accuracy of its truths.
AIMS = {"accuracy_avg": "mean", "accuracy_max": "greatest", "accuracy": "sum"}


def block_outcomes(base: ClaimBase, blocks: DataFrame, truth: DataFrame | None, model: Callable) -> DataFrame:
    """``block_id, mean_trust, COUNTS`` of the blocks (block_id, property), all resolved in one job."""
    result = model(base.with_blocks(blocks))
    outcome = result.summary().select("block_id", "mean_trust")
    if truth is None:
        return outcome.select("*", *[F.lit(None).cast("bigint").alias(c) for c in COUNTS])
    if result.groups is not None:
        judged = result.groups.confusion(truth, base.dealing, base.work)
    else:
        judged = confusion(base.votes_per_value(), truth, result.truths, ["block_id"], counted=True)
    return outcome.join(judged, "block_id", "left").select("block_id", "mean_trust", *COUNTS)


def report_rows(blocks: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Report rows of the partitions in ``blocks`` (partition_id, block_id, block).

    Blocks of a partition share no property, so its confusion counts are the sums of theirs.
    """
    summed = blocks.join(outcomes, "block_id").groupBy("partition_id").agg(
        F.count(F.lit(1)).alias("n_blocks"),
        F.max("mean_trust").alias("accuracy_max"),
        F.avg("mean_trust").alias("accuracy_avg"),
        *[F.sum(c).alias(c) for c in COUNTS],
    )
    judged = ratios(summed).withColumns({m: F.when(F.col("tp").isNotNull(), F.col(m)) for m in METRICS})
    return partition_lists(blocks).join(judged, "partition_id").select(*REPORT)


def _members(block_ids: DataFrame, names: list[str]) -> DataFrame:
    """``block_id, property`` of blocks by their bit masks."""
    listed = F.array(*[F.struct(F.lit(i).alias("bit"), F.lit(n).alias("property")) for i, n in enumerate(names)])
    each = block_ids.select("block_id", F.inline(listed))
    return each.where(F.expr("(block_id & shiftleft(1L, bit)) > 0")).select("block_id", "property")


def partition_report(
    claims: DataFrame,
    truth: DataFrame | None = None,
    model: Callable = depen,
    limit: int | None = None,
    max_properties: int = MAX_PROPERTIES,
    deduped: bool = False,
) -> DataFrame:
    """One row per partition: greatest and mean block trust, and the evaluation of its truths.

    Every distinct block is resolved once, all in the same job, and each partition is put
    together from its blocks.  ``limit`` takes the first partitions by id: no others are formed, nor
    blocks that only they have.  Without ``truth`` the evaluation columns are null.
    """
    base = ClaimBase.of(claims, deduped=deduped)
    names = property_names(base.facts, max_properties if limit is None else MOST_PROPERTIES)
    partitions = set_partitions(base.work.spark, names, limit, max_properties)
    blocks = base.work.keep(partition_blocks(partitions, names), "partition-blocks")
    used = blocks.select("block_id", F.explode("block").alias("property")).distinct()
    outcomes = block_outcomes(base, base.work.keep(used, "blocks"), truth, model)
    return report_rows(blocks, base.work.keep(outcomes, "outcomes"))


def best_partitions(
    claims: DataFrame,
    truth: DataFrame | None = None,
    model: Callable = depen,
    aims: tuple[str, ...] = ("accuracy_avg", "accuracy_max"),
    max_properties: int = MAX_PROPERTIES,
    deduped: bool = False,
) -> DataFrame:
    """The row of the report that is best in each of ``aims`` (a key of AIMS; ``accuracy`` needs ``truth``).

    Every block is resolved once; partitions are not listed but built up over subsets of the properties,
    so 12 properties take 266,000 merges instead of 4.2 million report rows.  Equal values (to
    nine places) go to the smallest partition id.
    """
    if unknown := set(aims) - AIMS.keys():
        raise ValueError(f"unknown aims {sorted(unknown)}")
    if truth is None and "accuracy" in aims:
        raise ValueError("the accuracy of a partition needs the truth")
    base = ClaimBase.of(claims, deduped=deduped)
    names = property_names(base.facts, max_properties)
    every = _members(base.work.spark.range(1, 1 << len(names)).withColumnRenamed("id", "block_id"), names)
    outcomes = base.work.keep(block_outcomes(base, base.work.keep(every, "blocks"), truth, model), "outcomes")
    found = None
    for aim in aims:
        # the claims judged are the same in every partition, so the accuracy is best where most are judged right
        score = F.col("tp") + F.col("tn") if aim == "accuracy" else F.col("mean_trust")
        best = best_partition_of(outcomes.select("block_id", score.alias("score")), len(names), base.work, AIMS[aim])
        row = best.select(F.lit(aim).alias("aim"), "partition_id", "labels")
        found = row if found is None else found.unionByName(row)
    found = base.work.keep(found, "best")
    listed = F.array(*[F.lit(n) for n in names])
    pairs = F.inline(F.arrays_zip(listed.alias("property"), F.col("labels").alias("label")))
    partitions = found.select("partition_id", "labels").distinct().select("partition_id", pairs)
    return found.select("aim", "partition_id").join(report_rows(partition_blocks(partitions, names), outcomes), "partition_id").select("aim", *REPORT)


def _table(base: ClaimBase, path: str) -> DataFrame | None:
    try:
        return base.work.spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def continue_report(
    claims: DataFrame,
    folder: str,
    truth: DataFrame | None = None,
    model: Callable = depen,
    share: int | None = None,
    max_properties: int = MAX_PROPERTIES,
    deduped: bool = False,
) -> DataFrame:
    """Go on with the partition report in ``folder`` (one that executors share) and return what it holds now.

    The report is keyed by the number of the partition and written in shares of the next ``share`` partitions (by
    default all that are missing).  The outcomes of blocks are kept beside it, keyed by block id: a share
    resolves only the blocks that no earlier one has.  What is missing is found by anti-joins, so a run that
    ended anywhere is taken up where it ended.  The claims, the truth and the model must be those of the run
    that began the report; other properties are an error.
    """
    base = ClaimBase.of(claims, deduped=deduped)
    spark, names = base.work.spark, property_names(base.facts, max_properties)
    listed = _table(base, f"{folder}/properties")
    if listed is None:
        spark.createDataFrame([(names,)], "names array<string>").coalesce(1).write.parquet(f"{folder}/properties")
    elif listed.first().names != names:
        raise ValueError(f"{folder} holds the report of other properties")
    report, known = (_table(base, f"{folder}/{part}") for part in ("report", "outcomes"))
    numbers = missing_numbers(spark, report, completions(len(names), 0), share)
    partitions = base.work.keep(partitions_at(numbers, names), "partitions")
    if not partitions.isEmpty():
        blocks = base.work.keep(partition_blocks(partitions, names), "partition-blocks")
        wanted = blocks.select("block_id", F.explode("block").alias("property")).distinct()
        if known is not None:
            wanted = wanted.join(known.select("block_id"), "block_id", "left_anti")
        wanted = base.work.keep(wanted, "blocks")
        if not wanted.isEmpty():
            block_outcomes(base, wanted, truth, model).write.mode("append").parquet(f"{folder}/outcomes")
        rows = report_rows(blocks, spark.read.parquet(f"{folder}/outcomes"))
        numbered = rows.join(partitions.select("partition_id", "number").distinct(), "partition_id")
        numbered.select("number", *REPORT).write.mode("append").parquet(f"{folder}/report")
    return spark.read.parquet(f"{folder}/report").select(*REPORT)


def missing_numbers(spark: SparkSession, report: DataFrame | None, total: int, share: int | None) -> DataFrame:
    """``id`` of the first ``share`` partitions that the report lacks, or of all of them."""
    if report is None:
        return spark.range(total if share is None else min(share, total))
    if share is not None:  # those missing before the last one written, and the next ones
        total = min(total, report.agg(F.max("number")).first()[0] + 1 + share)
    missing = spark.range(total).join(report.select(F.col("number").alias("id")), "id", "left_anti")
    return missing if share is None else missing.orderBy("id").limit(share)
