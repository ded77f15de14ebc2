"""TruthFinder: value confidence from source trust and similar values, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truthloom.functions.scores import clamp_trust, sigmoid, trust_score
from truthloom.operators.sets import SET
from truthloom.operators.similarity import KINDS, implied_scores
from truthloom.operators.skew import spread_join
from truthloom.plans.claimbase import BLOCK, ClaimBase
from truthloom.plans.packed import Packed, Rule, small
from truthloom.plans.rounds import TIES, Round, TruthResult, result_of, run_rounds, trust_from_sets


def packed_rounds(base: ClaimBase, groups: Packed, max_iterations: int, initial_trust: float, threshold: float, stop: str) -> TruthResult:
    """The rounds of :func:`truth_finder` on packed groups: a source's one factor is what its claims count."""
    work = base.work

    def step(state: Round, number: int) -> Round:
        own = F.col("source")
        factors = state.trust.select(*BLOCK, own.alias("s1"), own.alias("s2"), trust_score(F.col("trust")).alias("factor"))
        facts = groups.with_factors(factors, work, f"factors-{number}")
        sums, _ = facts.sums(work, f"sums-{number}")
        before = small(state.trust).select(*BLOCK, "source", F.col("trust").alias("old_trust"))
        trust = sums.withColumn("raw", F.col("total") / F.col("n")).join(before, [*BLOCK, "source"])
        trust = trust.select(*BLOCK, "source", clamp_trust(F.col("raw")).alias("trust"), "old_trust")
        return Round(work.keep(trust.coalesce(1), f"trust-{number}").coalesce(1), facts)

    seen, first = groups.sums(work, "first-sums")[0], F.lit(float(initial_trust))
    start = work.keep(seen.select(*BLOCK, "source", first.alias("trust"), first.alias("old_trust")).coalesce(1), "trust-0").coalesce(1)
    state, rounds = run_rounds(Round(start), step, max_iterations, threshold, stop)
    return result_of(base, state, rounds)


def truth_finder(
    claims: DataFrame | ClaimBase,
    rho: float = 0.5,
    theta: float = 0.1,
    max_iterations: int = 5,
    initial_trust: float = 0.8,
    threshold: float = 1e-6,
    similarity: str = "char",
    stop: str = "cosine",
    blocks: DataFrame | None = None,
    deduped: bool = False,
    tie: str = "min",
    seed: int = 10,
) -> TruthResult:
    """Iterate: score values by the trust of their sources, let similar values support each
    other, squash to a confidence, and set each source's trust to its mean confidence."""
    base = ClaimBase.of(claims, blocks, deduped)
    if tie not in TIES:
        raise ValueError(f"unknown tie policy {tie!r}")
    if similarity not in KINDS:
        raise ValueError(f"unknown similarity {similarity!r}")
    groups = base.packed(Rule(rho, theta, similarity == "numeric", seed if tie == "seeded" else None))
    if groups is not None:
        return packed_rounds(base, groups, max_iterations, initial_trust, threshold, stop)
    biggest = base.biggest_item if similarity == "numeric" else None

    def set_scores(trust: DataFrame) -> DataFrame:
        weighted = spread_join(base.block_members(), trust.select(*BLOCK, "source", "trust"), [*BLOCK, "source"],
                               base.hot_sources, ["source"], F.struct(*SET))
        return weighted.groupBy(*BLOCK, *SET).agg(F.sum(trust_score(F.col("trust"))).alias("score"))

    def step(state: Round, number: int) -> Round:
        scores = base.work.keep(set_scores(state.trust), f"scores-{number}")
        scored = base.scored_facts(scores, similarity == "char")
        if similarity == "numeric":  # read several times
            scored = base.work.keep(scored, f"scored-{number}")
        implied = implied_scores(scored, rho, similarity, BLOCK, base.hot_items, biggest)
        facts = base.work.keep(implied.withColumn("score", sigmoid(theta * F.col("score"))), f"facts-{number}")
        sets = facts.groupBy(*BLOCK, *SET).agg(
            F.count(F.lit(1)).alias("n_facts"), F.sum("score").alias("total")
        )
        trust = trust_from_sets(base, sets, state.trust, "total")
        trust = trust.select(*BLOCK, "source", clamp_trust(F.col("raw")).alias("trust"), "old_trust")
        return Round(base.work.keep(trust, f"trust-{number}"), facts)

    first = base.initial_trust(initial_trust)
    state, rounds = run_rounds(Round(first), step, max_iterations, threshold, stop)
    return result_of(base, state, rounds, tie, seed)
