from truthloom.functions.draws import draw, seeded_index, uniform
from truthloom.functions.scores import (
    accuracy_log_odds, clamp_trust, dependence_posterior, sigmoid, trust_score,
)
from truthloom.functions.text import char_weights, numeric_similarity, weights_dot

__all__ = [
    "draw", "uniform", "seeded_index", "accuracy_log_odds", "clamp_trust",
    "dependence_posterior", "sigmoid", "trust_score", "char_weights",
    "numeric_similarity", "weights_dot",
]
