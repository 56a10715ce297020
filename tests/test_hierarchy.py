from __future__ import annotations

import random

from tidemark.operators.hierarchy import descendants, resolve_hierarchy


def links_of(spark, rows, schema="child string, parent string"):
    return spark.createDataFrame(rows, schema)


def brute(rows):
    up = {}
    for c, p in rows:
        if c is not None and p is not None:
            up[c] = min(up.get(c, p), p)
    out = {}
    for n in set(up) | set(up.values()):
        seen, at, depth = {n}, n, 0
        while at in up:
            at, depth = up[at], depth + 1
            if at in seen:
                at, depth = "", -1
                break
            seen.add(at)
        out[n] = (at, depth)
    return out


def resolved(spark, rows):
    return {r["node"]: (r["root"], r["depth"]) for r in resolve_hierarchy(links_of(spark, rows), "child", "parent").collect()}


def test_random_forests_with_cycles(spark):
    rng = random.Random(7)
    rows = [(f"n{k}", f"n{rng.randrange(60)}") for k in range(60) if rng.random() < 0.8]
    rows += [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("self", "self")]
    rows += rows[:5] + [(None, "x"), ("x", None)]
    assert resolved(spark, rows) == brute(rows)


def test_long_chain_and_hot_parent(spark):
    rows = [(f"c{k:04d}", f"c{k - 1:04d}") for k in range(1, 300)] + [(f"leaf{k}", "c0299") for k in range(500)]
    got = resolved(spark, rows)
    assert got["c0299"] == ("c0000", 299) and got["leaf7"] == ("c0000", 300)


def test_chain_and_descendants(spark):
    full = resolve_hierarchy(links_of(spark, [("b", "a"), ("c", "b"), ("x", "y"), ("y", "x")]), "child", "parent", with_chain=True)
    chains = {r["node"]: r["chain"] for r in full.collect()}
    assert chains == {"a": [], "b": ["a"], "c": ["b", "a"], "x": None, "y": None}
    assert {tuple(r) for r in descendants(full).collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}


def test_empty_and_clashing_columns(spark):
    assert resolved(spark, []) == {}
    odd = spark.createDataFrame([("b", "a", "z", 1)], "node string, up string, root string, depth int")
    assert {tuple(r) for r in resolve_hierarchy(odd, "node", "up").collect()} == {("a", "a", 0), ("b", "a", 1)}
    two = links_of(spark, [("c", "b"), ("c", "a")])
    assert {tuple(r) for r in resolve_hierarchy(two, "child", "parent").collect()} == {("c", "a", 1), ("a", "a", 0)}
