"""Truth discovery over conflicting multi-source claims, as Spark DataFrame jobs."""

from truthloom.operators.quality import coverage, evaluate
from truthloom.operators.similarity import value_similarity
from truthloom.operators.votes import majority_vote, vote_counts
from truthloom.plans.accuracy import accu, accuracy_model, accusim, depen
from truthloom.plans.truthfinder import truth_finder
from truthloom.schema import as_claims, as_truth, claims_from_wide, dedupe_claims

__all__ = [
    "accu", "accuracy_model", "accusim", "as_claims", "as_truth", "claims_from_wide", "coverage",
    "dedupe_claims", "depen", "evaluate", "majority_vote", "truth_finder", "value_similarity",
    "vote_counts",
]
