from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import pytest

from tidemark.llm.cooccurrence import cooccurrence


def brute(rows, support, lift):
    baskets: dict = {}
    for b, i in rows:
        if b is not None and i is not None:
            baskets.setdefault(b, set()).add(i)
    one, two = Counter(), Counter()
    for items in baskets.values():
        one.update(items)
        two.update(combinations(sorted(items), 2))
    n = len(baskets)
    return {(a, b, one[a], one[b], k) for (a, b), k in two.items() if k >= support and k * n >= lift * one[a] * one[b]}


def found(spark, rows, support, lift, **more):
    df = spark.createDataFrame(rows, "rev string, path string")
    return {(r["item_a"], r["item_b"], r["n_a"], r["n_b"], r["n_ab"]) for r in cooccurrence(df, "rev", "path", support, lift, **more).collect()}


@pytest.mark.parametrize(("support", "lift", "block"), [(1, 1, 4), (2, 1, 3), (3, 2, 2), (8, 1, 5), (12, 1, 4)])
def test_against_brute_force(spark, support, lift, block):
    rng = random.Random(support)
    rows = [(f"r{b}", f"p{int(rng.expovariate(0.12))}") for b in range(60) for _ in range(rng.choice([1, 2, 5, 9, 40]))]
    rows += rows[:40] + [(None, "p1"), ("r1", None), ("r2", ""), ("r3", ""), ("r4", "")]
    want = brute(rows, support, lift)
    assert found(spark, rows, support, lift, block_rows=block) == want
    # postings of more than five rows are dealt to salts
    assert found(spark, rows, support, lift, block_rows=block, posting_rows=5) == want


def test_hot_basket_holds_a_third(spark):
    rows = [("huge", f"p{k}") for k in range(900)] + [(f"r{b}", f"p{(b * 7 + k) % 40}") for b in range(60) for k in range(8)]
    assert found(spark, rows, 3, 1, block_rows=16) == brute(rows, 3, 1)


def test_empty_and_clashing_columns(spark):
    assert found(spark, [], 2, 1) == set()
    df = spark.createDataFrame([("r", "a", "z", 1), ("r", "b", "z", 1)], "b1 string, key string, item string, n int")
    assert [(r["item_a"], r["item_b"], r["lift"], r["pmi"]) for r in cooccurrence(df, "b1", "key", 1, 1).collect()] == [("a", "b", 1.0, 0.0)]
    with pytest.raises(ValueError, match="at least 1"):
        cooccurrence(df, "b1", "key", 0)
