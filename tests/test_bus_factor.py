"""The greedy loss of experts against the loop it stands for, and its time on many authors."""

from __future__ import annotations

import random
import time

from tests.test_relations import store
from tidemark.operators import ownership


def by_loop(files):
    """Authors lost one after the other, counted anew each time."""
    left, lost = [set(w) for w in files], []
    while sum(not w for w in left) * 2 <= len(files):
        counts: dict = {}
        for w in left:
            for a in w:
                counts[a] = counts.get(a, 0) + 1
        lost.append(min(counts, key=lambda a: (-counts[a], a)))
        for w in left:
            w.discard(lost[-1])
    return len(lost), lost[0]


def run(spark, monkeypatch, files):
    rows = [(f"lib/f{k}", a, True) for k, w in enumerate(files) for a in w]
    monkeypatch.setattr(ownership, "doe_scores", lambda fs: spark.createDataFrame(rows, "path string, author string, is_expert boolean"))
    return ownership.bus_factor_doe(store(spark, [], [])).first()


def test_same_as_loop(spark, monkeypatch):
    for seed in range(4):
        rng = random.Random(seed)
        files = [{f"a{min(rng.randrange(12), rng.randrange(12))}" for _ in range(rng.randint(1, 4))} for _ in range(rng.choice([1, 2, 30]))]
        got = run(spark, monkeypatch, files)
        assert (got["bus_factor"], got["top_contributor"], got["total_commits"]) == (*by_loop(files), len(files))


def test_many_authors(spark, monkeypatch):
    began = time.monotonic()
    got = run(spark, monkeypatch, [{f"a{k:05d}", f"b{k:05d}"} for k in range(8_000)])
    assert (got["bus_factor"], got["total_commits"]) == (12_001, 8_000)
    assert time.monotonic() - began < 20
