from __future__ import annotations

import random

import pytest

from tidemark.llm.quantiles import ERROR_BOUND, bisect_percentiles, merge_partials, partial_counts, percentiles


def nearest_rank(values, p):
    values = sorted(values)
    return values[max(1, -(-p * len(values) // 100)) - 1]


@pytest.mark.parametrize("kind", ["long", "double"])
def test_against_sorting(spark, kind):
    rng = random.Random(5)
    make = (lambda: rng.randrange(-5, 10 ** rng.randrange(1, 17))) if kind == "long" else (lambda: rng.choice([-1, 1]) * rng.expovariate(1) * 10 ** rng.randrange(-12, 12))
    rows = [(f"g{rng.randrange(5)}", make()) for _ in range(800)] + [("one", make()), ("same", 3 if kind == "long" else 3.0), ("same", 3 if kind == "long" else 3.0)]
    hot = [("hot", make()) for _ in range(1500)]
    df = spark.createDataFrame(rows + hot + [("g1", None), (None, 4 if kind == "long" else 4.0), ("none", None)], f"g string, v {kind}")
    ps = (0, 1, 50, 90, 99, 100)
    groups: dict = {}
    for g, v in rows + hot + [(None, 4)]:
        groups.setdefault(g, []).append(v)
    got = {(r["g"], r["percent"]): r["value"] for r in percentiles(df, ["g"], "v", ps).collect()}
    assert got == {(g, p): nearest_rank(v, p) for g, v in groups.items() for p in ps}


def test_nan_empty_and_weights(spark):
    df = spark.createDataFrame([("a", float("nan"), 1), ("a", 1.0, 9), ("a", 2.0, 1), ("a", 5.0, 0), ("a", 7.0, None)], "lo string, v double, w int")
    assert {(r["percent"], r["value"], r["weight"]) for r in percentiles(df, ["lo"], "v", (90, 100), weight="w").collect()} == {(90, 1.0, 10), (100, 2.0, 10)}
    assert percentiles(df.where("false"), ["lo"], "v", (50,)).count() == 0
    with pytest.raises(ValueError, match="whole numbers"):
        percentiles(df, ["lo"], "v", (50.5,))


def test_portions_join_within_the_error(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(3), rng.randrange(10**6)) for _ in range(4000)]
    df = spark.createDataFrame(rows, "day int, v long")
    parts = [partial_counts(df.where(f"day = {d}"), [], "v") for d in range(3)]
    joined = {r["percent"]: r["value"] for r in bisect_percentiles(merge_partials(parts, []), [], (1, 50, 99)).collect()}
    for p, value in joined.items():
        true = nearest_rank([v for _, v in rows], p)
        assert abs(value - true) <= ERROR_BOUND * true
    exact = merge_partials([partial_counts(df.where(f"day = {d}"), [], "v", bits=None) for d in range(3)], [])
    assert bisect_percentiles(exact, [], (50,)).first()["value"] == nearest_rank([v for _, v in rows], 50)
