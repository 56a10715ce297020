from __future__ import annotations

import random

import pytest

from tidemark.llm.packing import OpenContainers, pack_documents, pack_items, token_counts


def check(rows, sizes, capacity):
    seen, used = {}, {}
    for d, piece, n, c in rows:
        seen.setdefault(d, []).append((piece, n))
        used[c] = used.get(c, 0) + n
    assert set(seen) == set(sizes)
    for d, pieces in seen.items():
        pieces.sort()
        assert [p for p, _ in pieces] == list(range(len(pieces)))
        assert sum(n for _, n in pieces) == sizes[d]
        assert (len(pieces) == 1) == (sizes[d] <= capacity)
        assert all(n == capacity for _, n in pieces[:-1])
    assert max(used.values()) <= capacity
    return used


def test_best_fit():
    space = OpenContainers(10, 2)
    assert [space.place(s) for s in (6, 7, 3, 4, 1)] == [0, 1, 1, 0, 2]
    assert space.leftovers() == [(2, 1)]
    with pytest.raises(ValueError, match="between"):
        space.place(11)


def test_packing(spark):
    rng = random.Random(6)
    sizes = {k: rng.choice([0, 1, 7, 40, 99, 100, 101, 250, 300]) for k in range(3000)}
    df = spark.createDataFrame(list(sizes.items()), "doc_id long, n_tokens long").repartition(7)
    used = check([tuple(r) for r in pack_items(df, 100, 8).collect()], sizes, 100)
    assert len(used) <= 1.1 * -(-sum(sizes.values()) // 100)


def test_empty_and_null_sizes(spark):
    df = spark.createDataFrame([(1, None)], "doc_id long, n_tokens long")
    assert pack_items(df, 10).count() == 0
    one = spark.createDataFrame([(1, 0)], "doc_id long, n_tokens long")
    assert [(r["doc_id"], r["piece"], r["n_tokens"]) for r in pack_items(one, 10).collect()] == [(1, 0, 0)]


def test_documents(spark):
    long_text = "lineage of a file " * 5000
    rows = [(1, "a short text", "x"), (2, "", "x"), (3, None, "x"), (4, long_text, "x"), (4, long_text, "x"), (None, "y", "x"), (5, "<|endoftext|> 日本語", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, container string")
    sizes = {r["doc_id"]: r["n_tokens"] for r in token_counts(df).collect()}
    assert set(sizes) == {1, 2, 4, 5} and sizes[2] == 0 and sizes[4] > 2048
    check([tuple(r) for r in pack_documents(df).collect()], sizes, 2048)
