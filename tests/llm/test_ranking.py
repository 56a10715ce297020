from __future__ import annotations

import random

import pytest

from tidemark.llm.ranking import ideal_point_ranking


def brute(rows, winsor=(1, 99)):
    best = {}
    for key, *s in rows:
        if key is not None:
            v = tuple(round(max(-9e12, min(9e12, x)) * 1e6) if x is not None and x == x and abs(x) != float("inf") else None for x in s)
            old = best.get(key)
            order = lambda t: tuple(-(10**30) if x is None else x for x in t)
            best[key] = v if old is None or order(v) > order(old) else old
    cols = list(zip(*best.values(), strict=True))
    near, far = {k: 0.0 for k in best}, {k: 0.0 for k in best}
    for c, col in enumerate(cols):
        known = sorted(x for x in col if x is not None)
        if not known:
            continue
        rank = lambda p: known[max(1, -(-p * len(known) // 100)) - 1]  # noqa: B023, E731
        low, mid, high = rank(winsor[0]), rank(50), rank(winsor[1])
        capped = {k: max(low, min(high, mid if v[c] is None else v[c])) for k, v in best.items()}
        length = sum(x * x for x in capped.values()) ** 0.5
        if not length or low == high:
            continue
        for k, x in capped.items():
            near[k] += ((high - x) / length) ** 2
            far[k] += ((x - low) / length) ** 2
    close = {k: round(far[k] ** 0.5 / (near[k] ** 0.5 + far[k] ** 0.5), 12) if near[k] + far[k] else 0.0 for k in best}
    return {k: (p, pytest.approx(close[k], abs=1e-9)) for p, k in enumerate(sorted(best, key=lambda k: (-close[k], k)), 1)}


def ranked(spark, rows):
    df = spark.createDataFrame(rows, "rev string, la double, ndev double, entropy double")
    return {r["key"]: (r["place"], r["closeness"]) for r in ideal_point_ranking(df, "rev", {"la": 1.0, "ndev": 1.0, "entropy": 1.0}).collect()}


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(f"r{k:03d}", float(int(rng.expovariate(0.001))), float(rng.randrange(9)), rng.random() * 3) for k in range(400)]
    rows += [("big", 1e9, 1.0, 0.1), ("huge", 3e12, 8.0, 2.0), ("huger", 1e300, 8.0, 2.9), ("least", -1e13, 0.0, 0.0), ("nan", float("nan"), 2.0, 0.2), ("null", None, None, None), ("inf", float("inf"), 1.0, 1.0), (None, 1.0, 1.0, 1.0)]
    rows += [("tie_b", 5.0, 5.0, 1.0), ("tie_a", 5.0, 5.0, 1.0)] + rows[:50]
    assert ranked(spark, rows) == brute(rows)


def test_no_scale_prevails(spark):
    base = [(f"r{k:02d}", float(k % 10), float(k // 10), float((k * 7) % 11)) for k in range(100)]
    scaled = [(k, a * 1000.0, b, c) for k, a, b, c in base]
    assert {k: v[0] for k, v in ranked(spark, base).items()} == {k: v[0] for k, v in ranked(spark, scaled).items()}


def test_very_large_scores_are_no_missing_ones(spark):
    rows = [(f"r{k}", 2e12 + k * 1e12, 1.0, 1.0) for k in range(10)]
    assert {k: v[0] for k, v in ranked(spark, rows).items()} == {f"r{k}": max(1, 10 - k) if k < 7 else k - 6 for k in range(10)}


def test_degenerate(spark):
    assert ranked(spark, []) == {}
    assert ranked(spark, [("b", 1.0, None, 2.0), ("a", 1.0, None, 2.0)]) == {"a": (1, 0.0), "b": (2, 0.0)}
    with pytest.raises(ValueError, match="positive weight"):
        ideal_point_ranking(spark.createDataFrame([], "k string, s double"), "k", {"s": 0.0})
