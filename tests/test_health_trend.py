"""Health over time needs the scores only."""

from __future__ import annotations

from tests.test_relations import days, store
from tidemark.operators import structure
from tidemark.session import staged_tables


def test_no_corpus_is_read(spark):
    """There is no table of strata, and no sample leaves more than its row."""
    paths = [f"lib/f{k}.rs" for k in range(12)]
    fs = store(spark, days(2), [(c, p, "modified", None, 1 + k, 0) for c in ("c1", "c2") for k, p in enumerate(paths)])
    fs = fs.replacing(blobs=spark.createDataFrame([(p, "rust", 1, "if a, b\n" * (1 + k % 3)) for k, p in enumerate(paths)], "path string, lang string, n_bytes long, content string"))
    before = len(staged_tables())
    rows = structure.health_trend(fs, samples=2).orderBy("k").collect()
    assert [(r["k"], r["files"]) for r in rows] == [(0, 12), (1, 12)]
    assert all(0 < r["code_health"] < 100 for r in rows)
    assert sum("commits" in getattr(t, "columns", []) or "content" in t.columns for t in staged_tables()[before:]) == 0
