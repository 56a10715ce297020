"""The corpus percentile against a count by hand."""

from __future__ import annotations

import random

import pytest

from tests.test_relations import store
from tidemark.operators import rankings

STRATA = "artifact_id string, lang string, sloc_min int, sloc_max int, sample_functions int, metrics array<struct<metric: string, quantiles: array<double>>>"
FILES = "path string, lang string, loc long, sloc long, cognitive long, cyclomatic long, bool_ops long, max_nesting long, nargs long, mi double"


def seeded(spark):
    """Overlapping ranges, quantiles with gaps and infinity, a missing value, and a range whose only stratum has no samples."""
    rng = random.Random(5)
    numbers = lambda: [*sorted(rng.choice([0.0, 1.0, 2.5, 7.0, float("inf")]) for _ in range(9)), None, float("nan")]
    strata = [(f"a{k}", "rust", low, high, 200 + k, [(m, numbers()) for m in rankings.CORPUS_METRICS]) for k, (low, high) in enumerate([(0, 19), (0, 19), (10, 99), (0, 99), (20, 99)])]
    strata.append(("none", "rust", 1000, 2000, 0, [(m, [1.0]) for m in rankings.CORPUS_METRICS]))
    sizes = [*(rng.randrange(110) for _ in range(60)), 1500]
    files = [(f"f{k}.rs", "rust", n, n, rng.randrange(9), rng.randrange(9), 0, rng.choice([None, 1, 7]), rng.randrange(9), 1.0) for k, n in enumerate(sizes)]
    want = {}
    for path, _, _, sloc, cognitive, cyclomatic, _, nesting, nargs, _ in files:
        best = []
        for m, v in {"cyclomatic": cyclomatic, "cognitive": cognitive, "sloc": sloc, "nargs": nargs, "max_nesting": nesting}.items():
            parts = []
            for _, _, low, high, n, metrics in strata:
                q = [x for x in dict(metrics)[m] if x is not None and x == x]
                if low <= sloc <= high:
                    parts.append((0 if v is None else (sum(x < v for x in q) + sum(x <= v for x in q)) / (2 * len(q)), n))
            if parts:
                weight = sum(n for _, n in parts)
                best.append(round(sum(p * n for p, n in parts) / weight, 9) if weight else None)
        if best:
            known = [b for b in best if b is not None]
            want[path] = max(known) if known else None
    changes = [(f"c{k}", path, "modified", None, 1, 0) for path, *_ in files for k in range(1 + int(path[1:-3]) % 3)]
    fs = store(spark, [{"rev": f"c{k}", "date": "2026-03-01 12:00:00"} for k in range(3)], changes)
    return fs.replacing(strata=spark.createDataFrame(strata, STRATA), files=spark.createDataFrame(files, FILES)), want


def test_corpus_lens_by_hand(spark):
    fs, want = seeded(spark)
    got = {r["path"]: r["corpus_percentile"] for r in rankings.corpus_lens(fs).collect()}
    assert got == {p: None if v is None else pytest.approx(v, abs=2e-9) for p, v in want.items()}


def test_hotspots_anchored_by_hand(spark):
    fs, want = seeded(spark)
    got = {r["path"]: r["corpus_percentile"] for r in rankings.hotspots_anchored(fs).collect()}
    assert got == {p: None if v is None else pytest.approx(v, abs=2e-9) for p, v in want.items()}


def test_code_health_reads_texts_once(spark):
    """What is ranked is stored: neither texts nor pairs of paths are worked out again for each rank."""
    fs, _ = seeded(spark)
    fs = fs.replacing(blobs=spark.createDataFrame([(f"f{k}.rs", "rust", 1, "if a, b") for k in range(12)], "path string, lang string, n_bytes long, content string"))
    fs._tables.pop("files")
    health = rankings.code_health(fs)
    plan = health._jdf.queryExecution().optimizedPlan().toString()
    assert health.count() == 12
    assert not [word for word in ("regexp_count", "posexplode", "content") if word in plan]
    fs.close()
