"""The loop shared by the iterative models."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from truthloom.functions.draws import seeded_index
from truthloom.functions.scores import log_bucket, log_of_buckets, scaled_exp, tie_key
from truthloom.operators.selection import at_positions
from truthloom.operators.sets import SET
from truthloom.operators.skew import spread_join
from truthloom.plans.claimbase import BLOCK, ClaimBase
from truthloom.plans.packed import Packed
from truthloom.plans.workspace import Workspace
from truthloom.schema import FACT, ITEM

TIES = ("min", "seeded")


def item_keys(facts: DataFrame) -> list[str]:
    """Columns that tell the items of all blocks apart, with those that facts are sorted and dealt by, if they are."""
    return [*[c for c in ("item_hash", "group_id") if c in facts.columns], *BLOCK, *ITEM]


def convergence(trust: DataFrame, group: list[str] = BLOCK) -> DataFrame:
    """Cosine and greatest difference between the trust vectors before and after a round.

    Both vectors are columns of one row per source, so they are aligned by source.
    """
    t, old = F.col("trust"), F.col("old_trust")
    cosine = F.sum(t * old) / (F.sqrt(F.sum(t * t)) * F.sqrt(F.sum(old * old)))
    return trust.groupBy(*group).agg(cosine.alias("cosine"), F.max(F.abs(t - old)).alias("max_abs_delta"))


def trust_summary(trust: DataFrame, group: list[str] = ()) -> DataFrame:
    return trust.groupBy(*group).agg(
        F.max("trust").alias("max_trust"), F.avg("trust").alias("mean_trust"), F.count(F.lit(1)).alias("n_sources")
    )


@dataclass
class Round:
    """Tables after one round: source trust, scored facts (none at the start) and, if used, dependence."""

    trust: DataFrame
    facts: DataFrame | Packed | None = None
    dependence: DataFrame | None = None
    history: tuple[DataFrame, ...] = ()

    def only(self, blocks: list) -> Round:
        keep = F.col("block_id").isin(blocks)
        dep = None if self.dependence is None else self.dependence.where(keep)
        return Round(self.trust.where(keep), self.facts.where(keep), dep)


def run_rounds(start: Round, step: Callable[[Round, int], Round], max_iterations: int,
               threshold: float, stop: str) -> tuple[Round, int]:
    """The state after the last round, with the trust of all rounds as ``history``, and their number.

    Apply ``step`` until every block has converged; a converged block is left as it is.

    ``stop="cosine"``: the cosine between successive trust vectors changes by less than
    ``threshold`` from one round to the next.  ``stop="max_abs_delta"``: no trust moves by
    ``threshold`` or more.  Only one row per block comes to the driver.
    """
    if stop not in ("cosine", "max_abs_delta"):
        raise ValueError(f"unknown stop rule {stop!r}")
    if max_iterations < 1:
        raise ValueError("a model needs at least one round")
    current, finished, cosines, history = start, [], {}, []

    def end(parts: list[Round]) -> Round:
        merged = _merge(parts)
        merged.history = tuple(history)
        return merged

    for number in range(1, max_iterations + 1):
        current = step(current, number)
        history.append(current.trust)
        if number == max_iterations:
            return end([*finished, current]), number
        running, done = [], []
        for row in convergence(current.trust).collect():
            if stop == "cosine":
                change = abs(cosines.get(row.block_id, 1.0) - row.cosine)
                cosines[row.block_id] = row.cosine
            else:
                change = row.max_abs_delta
            (done if change < threshold else running).append(row.block_id)
        if not running:
            return end([*finished, current]), number
        if done:
            finished.append(current.only(done))
            current = current.only(running)
    raise AssertionError("the last round returns")


def _merge(parts: list[Round]) -> Round:
    if len(parts) == 1:
        return parts[0]
    has_dep = parts[0].dependence is not None
    return Round(
        reduce(DataFrame.unionByName, [p.trust for p in parts]),
        reduce(type(parts[0].facts).unionByName, [p.facts for p in parts]),
        reduce(DataFrame.unionByName, [p.dependence for p in parts]) if has_dep else None,
    )


def trust_from_sets(base: ClaimBase, sets: DataFrame, trust: DataFrame, total: str) -> DataFrame:
    """Mean of a per-claim quantity over the claims of each source.

    ``sets`` has the number of facts and the ``total`` of the quantity per supporter set.
    """
    per_source = (
        base.member_values(sets.select(*BLOCK, *SET, "n_facts", total))
        .groupBy(*BLOCK, "source")
        .agg((F.sum(total) / F.sum("n_facts")).alias("raw"))
    )
    before = trust.select(*BLOCK, "source", F.col("trust").alias("old_trust"))
    return per_source.join(before, [*BLOCK, "source"])


def item_outcome(scored: DataFrame) -> DataFrame:
    """Per item: the winning value and the logarithm of the softmax mass, by partial aggregates.

    Scores may exceed what exp() can take, so masses are summed per score range and the few
    ranges of an item are combined relative to the highest one.
    """
    keys = [*BLOCK, *ITEM]
    won = F.struct((-tie_key(F.col("score"))).alias("below"), F.col("value").alias("value"))
    ranges = scored.groupBy(*keys, log_bucket(F.col("score")).alias("bucket")).agg(
        F.sum(scaled_exp(F.col("score"))).alias("mass"), F.min(won).alias("won")
    )
    whole = ranges.groupBy(*keys).agg(
        log_of_buckets(F.collect_list(F.struct("bucket", "mass"))).alias("log_mass"), F.min("won").alias("won")
    )
    return whole.select(*keys, "log_mass", F.col("won.value").alias("best_value"))


def seeded_winners(scored: DataFrame, hot_items: DataFrame | None, seed: int, work: Workspace) -> DataFrame:
    """``block, item, value`` at the position that a seeded choice picks among the tied values."""
    keys = [*BLOCK, *ITEM]
    tie = tie_key(F.col("score"))
    top = scored.groupBy(*keys).agg(F.max(tie).alias("top"))
    tied = spread_join(scored, top, keys, hot_items, ITEM, F.col("value")).where(tie == F.col("top")).select(*keys, "value")
    sizes = tied.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_tied")).withColumn("pick", seeded_index(F.col("n_tied"), seed))
    placed = spread_join(tied, sizes, keys, hot_items, ITEM, F.col("value")).select(*keys, "value", "pick")
    return at_positions(placed, keys, "value", "pick", work).select(*keys, "value")


def with_outcome(scored: DataFrame, hot_items: DataFrame | None = None, tie: str = "min", seed: int = 10,
                 work: Workspace | None = None) -> DataFrame:
    """Add the softmax probability of each fact and whether it wins its item.

    ``tie="min"`` prefers the smallest tied value, ``tie="seeded"`` a seeded choice; then
    ``scored`` is read twice.

    Items of ordinary size take one shuffle and window sums over the item.  When some item
    holds a large share of all facts, its window would be a single task: then outcomes are
    aggregated per item and joined back with the hot items cut into pieces.
    """
    if tie not in TIES:
        raise ValueError(f"unknown tie policy {tie!r}")
    keys = [*BLOCK, *ITEM]
    if tie == "seeded":
        picked = seeded_winners(scored, hot_items, seed, work or Workspace(scored.sparkSession)).withColumn("picked", F.lit(True))
        judged = with_outcome(scored, hot_items).drop("is_best").join(picked, [*keys, "value"], "left")
        return judged.withColumn("is_best", F.coalesce("picked", F.lit(False))).drop("picked")
    if hot_items is not None:
        joined = spread_join(scored, item_outcome(scored), keys, hot_items, ITEM, F.col("value"))
        return joined.withColumn("probability", F.exp(F.col("score") - F.col("log_mass"))).withColumn(
            "is_best", F.col("value") == F.col("best_value")
        )
    item = W.partitionBy(*item_keys(scored))
    topped = scored.withColumn("tie", tie_key(F.col("score"))).withColumn("top", F.max("score").over(item))
    topped = topped.withColumn("tied_value", F.when(F.col("tie") == tie_key(F.col("top")), F.col("value")))
    weighed = topped.withColumn("weight", F.exp(F.col("score") - F.col("top")))
    return weighed.select(
        *scored.columns,
        (F.col("weight") / F.sum("weight").over(item)).alias("probability"),
        F.coalesce(F.col("tied_value") == F.min("tied_value").over(item), F.lit(False)).alias("is_best"),
    )


@dataclass
class TruthResult:
    """What a model found.  Every table has ``block_id`` when blocks were given.

    ``truths``      object, property, value, confidence, votes (sources that claim the value)
    ``confidence``  object, property, value, confidence for every claimed value
    ``trust``       source, trust, old_trust
    ``dependence``  s1, s2, kt, kf, kd, dep (copy-aware models only)
    ``history``     the trust tables of all rounds, of the blocks that were still running
    ``groups``      the packed groups that the truths are read off, if rounds were packed
    """

    truths: DataFrame
    confidence: DataFrame
    trust: DataFrame
    dependence: DataFrame | None
    rounds: int
    work: object
    history: tuple[DataFrame, ...] = ()
    groups: Packed | None = None

    def summary(self) -> DataFrame:
        return trust_summary(self.trust, [c for c in BLOCK if c in self.trust.columns])


def result_of(base: ClaimBase, state: Round, rounds: int, tie: str = "min", seed: int = 10) -> TruthResult:
    """The result is read off the facts that the last round wrote."""
    packed = isinstance(state.facts, Packed)
    if packed:
        truths = state.facts.truths()
    elif tie == "min":
        truths = item_outcome_best(state.facts)
    else:
        confidence = state.facts.select(*BLOCK, *FACT, F.col("score").alias("confidence"), F.col("set_size").alias("votes"))
        picked = seeded_winners(state.facts.select(*BLOCK, *FACT, "score"), base.hot_items, seed, base.work)
        truths = confidence.join(picked, [*BLOCK, *FACT], "left_semi")
    named = state.facts.confidence() if packed else state.facts.select(*BLOCK, *FACT, F.col("score").alias("confidence"))
    tables, history = [truths, named, state.trust, state.dependence], state.history
    if base.blocks is None:
        tables = [t if t is None else t.drop("block_id") for t in tables]
        history = tuple(t.drop("block_id") for t in history)
    return TruthResult(*tables, rounds, base.work, history, state.facts if packed else None)


def item_outcome_best(scored: DataFrame) -> DataFrame:
    won = F.min(F.struct((-tie_key(F.col("score"))).alias("below"), F.col("value"), F.col("score"), F.col("set_size"))).alias("won")
    return scored.groupBy(*item_keys(scored)).agg(won).select(
        *BLOCK, *ITEM, F.col("won.value").alias("value"), F.col("won.score").alias("confidence"), F.col("won.set_size").alias("votes")
    )
