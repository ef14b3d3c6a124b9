"""Settings of candidate generation."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed value: the order of the signals, and their default weights.
SIGNALS = ("params_coverage", "text_coverage", "text_similarity", "location_match", "microcat_match")
SCORES = ("params_coverage_score", "text_coverage_score", "text_similarity_score", "location_match_score", "microcat_match_score")


# The defaults.
@dataclass(frozen=True)
class GeneratorConfig:
    """``signal_weights`` needs all five signals; ``pair_chunks`` is into how many parts items are cut for scoring."""

    top_k: int = 500
    unspecified_category_value: int = 0
    min_token_len: int = 2
    params_similarity_threshold: float = 0.82
    rrf_k: int = 60
    signal_weights: dict = field(default_factory=lambda: dict.fromkeys(SIGNALS, 1.0))
    location_decay_km: float = 5.0
    random_seed: int = 42
    pair_chunks: int = 64

    def weights(self) -> list[float]:
        if missing := set(SIGNALS) - set(self.signal_weights):
            raise ValueError(f"no weight for {sorted(missing)}")
        return [float(self.signal_weights[s]) for s in SIGNALS]
