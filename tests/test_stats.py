from __future__ import annotations

import math
from itertools import product

import pytest
from pyspark.sql import functions as F

from tidemark.functions import stats


def exact(a, b, c, d):
    n, row, col = a + b + c + d, a + b, a + c
    p = lambda k: math.comb(row, k) * math.comb(n - row, col - k) / math.comb(n, col)
    ks = range(max(0, col - (n - row)), min(row, col) + 1)
    return min(1.0, sum(p(k) for k in ks if p(k) <= p(a) * (1 + 1e-9)))


def test_fisher_against_binomials():
    for a, b, c, d in product((0, 1, 3, 8), repeat=4):
        got = stats.fisher_two_tailed(a, b, c, d)
        if 0 in (a + b, c + d, a + c, b + d):
            assert got is None
        else:
            assert got == pytest.approx(exact(a, b, c, d), abs=1e-9)
    assert stats.fisher_two_tailed(-1, 2, 3, 4) is None


def test_benjamini_hochberg(spark):
    rows = [(0.001,), (0.008,), (0.039,), (0.041,), (0.2,), (None,), (0.008,)]
    kept = stats.benjamini_hochberg(spark.createDataFrame(rows, "p double"), "p", 0.05).collect()
    assert sorted(r["p"] for r in kept) == [0.001, 0.008, 0.008, 0.039, 0.041]
    assert stats.benjamini_hochberg(spark.createDataFrame([], "p double"), "p", 0.05).count() == 0


def test_wilson(spark):
    low, high = stats.wilson_interval(F.col("k"), F.col("n"))
    r = spark.createDataFrame([(5, 10), (0, 0), (10, 10)], "k int, n int").select(low.alias("l"), high.alias("h")).collect()
    assert r[0]["l"] == pytest.approx(0.2366, abs=1e-4) and r[0]["h"] == pytest.approx(0.7634, abs=1e-4)
    assert r[1]["l"] is None or r[1]["l"] == 0.0
    assert r[2]["h"] == 1.0


def test_auc_and_precision(spark):
    df = spark.createDataFrame([(3, True, "a"), (2, True, "b"), (2, False, "c"), (1, False, "d")], "s int, y boolean, t string")
    assert stats.roc_auc(df, "s", "y").first()["auc"] == pytest.approx(0.875)
    assert stats.roc_auc(df.where("y"), "s", "y").first()["auc"] is None
    assert stats.precision_at(df, "s", "y", "t", 3).first()["precision"] == pytest.approx(2 / 3)


def test_control_chart():
    assert not stats.control_chart([1, 2, 3])["attention"]
    assert stats.control_chart([1, 1, 2, 1, 2, 1, 9])["attention"]
    assert stats.control_chart([9, 9, 1, 1, 2, 1, 2, 1, 1, 2])["attention"]


def test_tuning():
    import random

    from tidemark.functions.tuning import auc_of, tune_weights

    rng = random.Random(1)
    rows = [(rng.random(), rng.random()) for _ in range(400)]
    labels = [a > 0.6 for a, _ in rows]
    weights, auc, accepted = tune_weights(rows, labels, (0.5, 0.5))
    assert accepted and weights[0] > weights[1] and sum(weights) == pytest.approx(1.0)
    assert auc > auc_of(__import__("numpy").asarray(rows) @ [0.5, 0.5], __import__("numpy").asarray(labels))
    assert tune_weights(rows[:20], labels[:20], (0.5, 0.5))[2] is False
    assert tune_weights([], [], (1.0,)) == ([1.0], None, False)
