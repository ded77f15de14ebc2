"""Copy-aware models: DEPEN, ACCU and ACCUSIM."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truthloom.functions.scores import clamp_trust
from truthloom.operators.dependence import agreement, dependence, vote_factors
from truthloom.operators.sets import SET
from truthloom.operators.similarity import implied_scores
from truthloom.operators.skew import pair_join, spread_join
from truthloom.plans.claimbase import BLOCK, ClaimBase
from truthloom.plans.packed import Packed, Rule, small
from truthloom.plans.rounds import TIES, Round, TruthResult, result_of, run_rounds, trust_from_sets, with_outcome
from truthloom.schema import ITEM

ALGORITHMS = ("DEPEN", "ACCU", "ACCUSIM")


def majority_sets(base: ClaimBase, tie: str = "min", seed: int = 10) -> DataFrame:
    """``block, SET, n_true`` when the majority value of each item is taken as true."""
    votes = base.facts.withColumns({"block_id": F.lit(0), "score": F.col("set_size").cast("double")})
    true_facts = with_outcome(votes, base.hot_items, tie, seed, base.work).where("is_best").select(*ITEM, *SET)
    return base.in_blocks(true_facts).groupBy(*BLOCK, *SET).agg(F.count(F.lit(1)).alias("n_true"))


def source_dependence(base: ClaimBase, sets: DataFrame, trust: DataFrame, c: float, n: float, alpha: float) -> DataFrame:
    """Dependence of every ordered pair of sources that share an item."""
    counts = agreement(base.pairs, base.true_pairs(sets), BLOCK)
    return dependence(counts, trust, BLOCK, c, n, alpha, base.hub_sources)


def discounted_votes(base: ClaimBase, factors: DataFrame) -> DataFrame:
    """``block, SET, score``: sum over the sources of a set of their discounted votes.

    A source's vote is multiplied by one factor per source of the same set that ranks
    before it.  The factors are broadcast while Spark finds them small; then pairs are
    formed, joined and multiplied up in one stage.  Beyond that, pairs of sources that meet
    very often are spread over several join keys.
    """
    pairs = pair_join(base.block_members(), base.members, SET, "set_size", "source", F.lit(True), base.size.biggest_set).select(
        "l.block_id", *[f"l.{k}" for k in SET], F.col("l.source").alias("s1"), F.col("r.source").alias("s2")
    )
    joined = spread_join(pairs, factors, [*BLOCK, "s1", "s2"], base.hot_pairs, ["s1", "s2"], F.struct(*SET))
    votes = joined.groupBy(*BLOCK, *SET, "s1").agg(
        F.product("factor").alias("vote")
    )
    return votes.groupBy(*BLOCK, *SET).agg(F.sum("vote").alias("score"))


def packed_rounds(base: ClaimBase, groups: Packed, algo: str, max_iterations: int, initial_trust: float, threshold: float,
                  c: float, n: float, alpha: float, order: str, stop: str) -> TruthResult:
    """The rounds on packed groups; the tables of sources and pairs stay as in :func:`accuracy_model`."""
    work = base.work
    seen, pairs = groups.sums(work, "first-sums")
    pairs = pairs.where("n_common > 0")

    def keep(rows: DataFrame, name: str) -> DataFrame:
        """A table of sources or pairs: one file, read as one partition, so that sums over it need no shuffle."""
        return work.keep(rows.coalesce(1), name).coalesce(1)

    def judged(trust: DataFrame, true: DataFrame) -> DataFrame:
        counts = agreement(pairs.drop("n_true"), small(true.select(*BLOCK, "s1", "s2", "n_true")), BLOCK)
        return dependence(counts, F.broadcast(trust), BLOCK, c, n, alpha)

    def step(state: Round, number: int) -> Round:
        factors = vote_factors(F.broadcast(state.dependence), state.trust, BLOCK, algo, c, n, order)
        facts = groups.with_factors(factors, work, f"factors-{number}")
        sums, true = facts.sums(work, f"sums-{number}")
        before = small(state.trust).select(*BLOCK, "source", F.col("trust").alias("old_trust"))
        trust = sums.withColumn("raw", F.col("total") / F.col("n")).join(before, [*BLOCK, "source"])
        trust = trust.select(*BLOCK, "source", clamp_trust(F.col("raw")).alias("trust"), "old_trust")
        trust = keep(trust, f"trust-{number}")
        return Round(trust, facts, judged(trust, true))

    first = F.lit(float(initial_trust))
    trust = keep(seen.select(*BLOCK, "source", first.alias("trust"), first.alias("old_trust")), "trust-0")
    state, rounds = run_rounds(Round(trust, None, judged(trust, pairs)), step, max_iterations, threshold, stop)
    return result_of(base, state, rounds)


def accuracy_model(
    claims: DataFrame | ClaimBase,
    algo: str = "DEPEN",
    rho: float = 0.5,
    max_iterations: int = 5,
    initial_trust: float = 0.8,
    threshold: float = 1e-6,
    c: float = 0.3,
    n: float = 100,
    alpha: float = 0.5,
    order: str = "dependence",
    similarity: str = "char",
    stop: str = "cosine",
    blocks: DataFrame | None = None,
    deduped: bool = False,
    tie: str = "min",
    seed: int = 10,
) -> TruthResult:
    """Start from the majority vote, then repeat: discount votes of likely copiers, turn vote
    counts into probabilities, set each source's trust to its mean probability, pick the
    truths, and judge dependence again.

    DEPEN gives every source one vote, ACCU weighs it by trust, ACCUSIM also lets similar
    values support each other.
    """
    if algo not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algo!r}")
    base = ClaimBase.of(claims, blocks, deduped)
    if tie not in TIES:
        raise ValueError(f"unknown tie policy {tie!r}")
    rule = Rule(rho if algo == "ACCUSIM" else None, seed=seed if tie == "seeded" else None)
    groups = base.packed(rule) if algo != "ACCUSIM" or similarity == "char" else None
    if groups is not None:
        return packed_rounds(base, groups, algo, max_iterations, initial_trust, threshold, c, n, alpha, order, stop)
    biggest = base.biggest_item if similarity == "numeric" else None

    def step(state: Round, number: int) -> Round:
        factors = vote_factors(state.dependence, state.trust, BLOCK, algo, c, n, order, base.hub_sources)
        scores = base.work.keep(discounted_votes(base, factors), f"scores-{number}")
        spelled = algo == "ACCUSIM" and similarity == "char"
        facts = base.scored_facts(scores, spelled)
        if algo == "ACCUSIM":
            if similarity == "numeric" or base.hot_items is not None:  # read several times
                facts = base.work.keep(facts, f"scored-{number}")
            facts = implied_scores(facts, rho, similarity, BLOCK, base.hot_items, biggest)
            if base.hot_items is not None or tie != "min":
                facts = base.work.keep(facts, f"implied-{number}")
            judged = facts = base.work.keep(with_outcome(facts, base.hot_items, tie, seed, base.work), f"facts-{number}")
        else:
            if base.hot_items is not None or tie != "min":
                facts = base.work.keep(facts, f"scored-{number}")
            judged = with_outcome(facts, base.hot_items, tie, seed, base.work)
        sets = judged.groupBy(*BLOCK, *SET).agg(
            F.count(F.lit(1)).alias("n_facts"),
            F.sum("probability").alias("total"),
            F.sum(F.col("is_best").cast("bigint")).alias("n_true"),
        )
        sets = base.work.keep(sets, f"sets-{number}")
        trust = trust_from_sets(base, sets, state.trust, "total")
        trust = trust.select(*BLOCK, "source", clamp_trust(F.col("raw")).alias("trust"), "old_trust")
        trust = base.work.keep(trust, f"trust-{number}")
        dep = source_dependence(base, sets, trust, c, n, alpha)
        if number < max_iterations:  # after the last round it is only computed when asked for
            dep = base.work.keep(dep, f"dependence-{number}")
        return Round(trust, facts, dep)

    trust = base.initial_trust(initial_trust)
    dep = base.work.keep(source_dependence(base, majority_sets(base, tie, seed), trust, c, n, alpha), "dependence-0")
    state, rounds = run_rounds(Round(trust, None, dep), step, max_iterations, threshold, stop)
    return result_of(base, state, rounds, tie, seed)


def depen(claims: DataFrame | ClaimBase, **options) -> TruthResult:
    return accuracy_model(claims, "DEPEN", **options)


def accu(claims: DataFrame | ClaimBase, **options) -> TruthResult:
    return accuracy_model(claims, "ACCU", **options)


def accusim(claims: DataFrame | ClaimBase, **options) -> TruthResult:
    return accuracy_model(claims, "ACCUSIM", **options)


__all__ = ["ALGORITHMS", "accuracy_model", "accu", "accusim", "depen"]
