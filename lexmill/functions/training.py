"""Arithmetic around model training: step budgets, warm-up lengths, pooling modes."""

from __future__ import annotations

import math

#: Pooling of token vectors by kind of model; mean where a kind isn't listed.
POOLING = {"encoder": "mean", "decoder": "lasttoken"}


def pooling_mode(kind: str) -> str:
    return POOLING.get(kind, "mean")


def calibrated_steps(trial_steps: int, minutes: float, elapsed_seconds: float, least: int = 50) -> int:
    """Steps that fit into so many minutes, from the time of a trial run."""
    return max(least, round(trial_steps * minutes * 60 / elapsed_seconds))


def triplet_warmup(n_triplets: int, epochs: int = 3, batch: int = 32, most: int = 100) -> int:
    """A tenth of all steps, between 1 and ``most``."""
    total = epochs * max(1, math.ceil(n_triplets / batch))
    return max(1, min(most, total // 10))


def ratio_warmup(n_batches: int, epochs: int, ratio: float) -> int:
    return int(n_batches * epochs * ratio)
