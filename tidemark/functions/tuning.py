"""Weights of a score tuned on a small validation set, on the driver."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

STEPS = (0.5, 0.75, 1.0, 1.25, 1.5)
MAX_ROWS = 100_000


def auc_of(scores: np.ndarray, labels: np.ndarray) -> float | None:
    """Area under the curve by mid-ranks; ``None`` unless both labels occur."""
    positive = int(labels.sum())
    negative = len(labels) - positive
    if not positive or not negative:
        return None
    _, index, counts = np.unique(scores, return_inverse=True, return_counts=True)
    upto = np.cumsum(counts)
    ranks = (upto - (counts - 1) / 2)[index]
    return float((ranks[labels.astype(bool)].sum() - positive * (positive + 1) / 2) / (positive * negative))


def tune_weights(features: Sequence[Sequence[float]], labels: Sequence[bool], weights: Sequence[float], passes: int = 2, gain: float = 0.02, floor: float = 0.5, min_positive: int = 30) -> tuple[list[float], float | None, bool]:
    """``(weights, auc, accepted)`` after coordinate descent over multiples of each weight.

    Weights are rescaled to their original sum. They are accepted only with at least ``min_positive``
    positives, an area of at least ``floor``, and a gain of at least ``gain`` over the given weights. At most
    100,000 rows are taken: this runs on a validation set, not on a corpus.
    """
    x, y = np.asarray(features, float), np.asarray(labels, bool)
    if len(x) > MAX_ROWS:
        raise ValueError("a validation set has at most 100,000 rows")
    start = np.asarray(weights, float)
    total = start.sum()
    best, base = start.copy(), auc_of(x @ start, y) if len(x) else None
    if base is None or int(y.sum()) < min_positive:
        return list(map(float, start)), base, False
    reached = base
    for _ in range(passes):
        for k in range(len(best)):
            for step in STEPS:
                trial = best.copy()
                trial[k] = start[k] * step
                trial *= total / trial.sum()
                score = auc_of(x @ trial, y)
                if score is not None and score > reached + 1e-12:
                    reached, best = score, trial
    if reached >= base + gain and reached >= floor:
        return list(map(float, best)), reached, True
    return list(map(float, start)), base, False
