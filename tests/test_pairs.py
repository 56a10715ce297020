"""Pairs counted block by block against brute force."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import pytest

from tests.test_relations import days, store
from tidemark.operators import coupling


@pytest.mark.parametrize("block", [7, 1000])
def test_frequent_pairs_against_brute_force(spark, block):
    from tidemark.operators.pairs import frequent_pairs

    rng = random.Random(block)
    groups = {f"g{k}": {f"i{rng.randrange(40)}" for _ in range(rng.choice([1, 9, 30]))} for k in range(40)}
    own = Counter(i for items in groups.values() for i in items)
    pairs = Counter(p for items in groups.values() for p in combinations(sorted(items), 2))
    want = {p: n for p, n in pairs.items() if n >= 3 and n >= 0.3 * (own[p[0]] + own[p[1]])}
    df = spark.createDataFrame(sorted((g, i) for g, items in groups.items() for i in items), "g string, i string")
    assert {(r["a"], r["b"]): r["shared"] for r in frequent_pairs(df, "g", "i", 3, 0.3, block=block).collect()} == want


def test_pairs_of_a_day_are_not_moved(spark):
    changes = [(f"c{k}", p, "modified") for k in range(1, 7) for p in ("x", "y", *([] if k % 2 else ["z"]))]
    pairs = coupling.coupling_pairs(store(spark, days(6), changes, time_bucket="day", min_revs=2, min_shared_revs=2, min_coupling_pct=20.0))
    assert "posexplode" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["entity_a"], r["entity_b"], r["shared"], r["revs_a"], r["revs_b"], r["n"]) for r in pairs.collect()} == {("x", "y", 6, 6, 6, 6), ("x", "z", 3, 6, 3, 6), ("y", "z", 3, 6, 3, 6)}
