from __future__ import annotations

import heapq
import random

import pytest

from tidemark.llm.topn import LoserTree, merge_runs, top_n_per_group


def brute(rows, n):
    best: dict = {}
    for g, i, s in rows:
        if g is not None and i is not None and s is not None and s == s:
            best.setdefault(g, {})
            best[g][i] = max(best[g].get(i, s), s)
    return {(g, i, s, k) for g, items in best.items() for k, (i, s) in enumerate(sorted(items.items(), key=lambda x: (-x[1], x[0]))[:n], 1)}


def test_loser_tree_merges_like_a_heap():
    rng = random.Random(3)
    for size in (1, 2, 3, 7, 8):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(12))) for _ in range(size)]
        want = list(heapq.merge(*runs))
        at = [0] * size
        head = lambda k: (0, runs[k][at[k]]) if at[k] < len(runs[k]) else (1,)  # noqa: B023, E731
        tree, got = LoserTree([head(k) for k in range(size)]), []
        while tree.heads[tree.winner] != (1,):
            got.append(tree.heads[tree.winner][1])
            at[tree.winner] += 1
            tree.replace(head(tree.winner))
        assert got == want
    assert list(merge_runs([], 2)) == []


@pytest.mark.parametrize("n", [1, 3, 50])
def test_against_brute_force(spark, n):
    rng = random.Random(n)
    rows = [(f"g{int(rng.expovariate(0.3))}", f"a{rng.randrange(60)}", float(rng.randrange(6))) for _ in range(3000)]
    rows += [("hot", f"a{k}", float(k % 5)) for k in range(2000)] + rows[:200]
    rows += [(None, "a", 1.0), ("g1", None, 9.0), ("g1", "x", None), ("g1", "y", float("nan")), ("", "", -1.0), ("g1", "é", 5.0), ("g1", "z", 5.0)]
    df = spark.createDataFrame(rows, "path string, author string, k double")
    got = {tuple(r) for r in top_n_per_group(df, "path", "author", "k", n, bucket_rows=500).collect()}
    assert got == brute(rows, n)


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([("g", "i", 1.0, 7)], "run string, bucket string, s double, g int")
    assert [tuple(r) for r in top_n_per_group(df, "run", "bucket", "s").collect()] == [("g", "i", 1.0, 1)]
    assert top_n_per_group(df.where("false"), "run", "bucket", "s").count() == 0
    with pytest.raises(ValueError, match="n must"):
        top_n_per_group(df, "run", "bucket", "s", 0)
