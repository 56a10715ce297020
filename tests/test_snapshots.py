from __future__ import annotations

from pyspark.sql import functions as F

from tests.test_relations import days, store
from tidemark.operators import snapshots as snap
from tidemark.operators import structure
from tidemark.sources.cache import cached_facts, store_key


def test_numbers(spark):
    rows = [
        ("r1", "limit 24.4, value 9.41 and 7 files"),
        ("r1", "24 of 30 tests; half is 50 percent; v2.1 stays"),
        ("r2", "no facts: 3 and 13"),
        ("r3", None),
    ]
    statements = spark.createDataFrame(rows, "id string, text string")
    facts = spark.createDataFrame([("r1", 24.4), ("r1", 9.4071), ("r1", 0.5), ("r1", None)], "id string, value double")
    got = {(r["id"], r["text"]): r["unsupported"] for r in snap.citation_check(statements, facts, "id").collect()}
    assert got[rows[0]] == []
    assert got[rows[1]] == ["30"]
    assert got[rows[2]] == ["13"]
    assert got[rows[3]] is None


def test_store_at(spark):
    fs = store(spark, days(4), [("c1", "a", "added"), ("c2", "b", "added"), ("c3", "a", "deleted"), ("c4", "c", "added")])
    then = snap.store_at(fs, "2026-03-02 23:00:00")
    assert {r["path"] for r in then.live_paths.collect()} == {"a", "b"}
    assert then.commits.count() == 2


def test_diff_gates(spark):
    report = spark.createDataFrame([("a", 90.0, 80.0, -10.0, False), ("b", None, 20.0, None, True)], "path string, health_before double, health_after double, delta double, newly_cyclic boolean")
    found = {(r["gate"], r["path"]) for r in snap.diff_gates(report, {"delta_code_health_min": -5.0, "new_file_health_min": 50.0, "no_new_cycles": 1}).collect()}
    assert found == {("delta_code_health_min", "a"), ("new_file_health_min", "b"), ("no_new_cycles", "b")}


def test_cache(spark, tmp_path):
    fs = store(spark, days(2), [("c1", "a", "modified", None, 3, 1), ("c2", "b", "added")])
    key = store_key("repo", "c2", grouping="none")
    assert key != store_key("repo", "c3", grouping="none")
    first = cached_facts(fs, str(tmp_path), key, ("hunks",))["hunks"].collect()
    again = cached_facts(store(spark, [], []), str(tmp_path), key, ("hunks",))["hunks"].collect()
    assert first == again and len(first) == 1


def test_overlay(spark):
    fs = store(spark, days(1), [("c1", "a", "added")])
    edited = spark.createDataFrame([("x/y/a.py", "python", "if a:\n    pass")], "path string, lang string, content string")
    assert snap.overlay(fs, edited).files.select(F.sum("cognitive")).first()[0] == 1
    assert snap.overlay(snap.overlay(fs, edited), edited.where("false"), edited).files.count() == 0


def test_cycle_origins_of_every_commit(spark):
    rows, changes = [], []
    words = ["ape", "bee", "cat", "dog", "elk", "fox", "gnu", "hen"]
    commits = [{"rev": f"c{k:02d}", "date": f"2026-03-{k:02d} 12:00:00"} for k in range(1, 29)]
    for n, (a, b) in enumerate(zip(words[::2], words[1::2], strict=True)):
        for own, other in ((a, b), (b, a)):
            rows.append((f"top/repo/{own}_x.rs", "rust", 1, f"use crate::{other};"))
        changes += [("c01", f"top/repo/{a}_x.rs", "added"), (f"c{3 + n:02d}", f"top/repo/{b}_x.rs", "added")]
    changes += [("c20", "top/repo/ape_x.rs", "deleted"), ("c21", "top/repo/ape_x.rs", "added")]
    fs = store(spark, commits, changes).replacing(blobs=spark.createDataFrame(rows, "path string, lang string, n_bytes long, content string"))
    got = {r["cycle_id"]: (r["size"], r["k"], r["formed_at_rev"]) for r in structure.cycle_origins(fs).collect()}
    assert got == {n + 1: (2, 2 + n, f"c{3 + n:02d}") for n in range(4)}
    trend = {r["k"]: r["cycle_count"] for r in structure.architecture_trend(fs).collect()}
    assert trend == {0: 0, 1: 1, 2: 3, **dict.fromkeys(range(3, 12), 4), 8: 3}  # sample 8 is c20
    # three cycles of two files among seven at sample 2
    health = {r["k"]: r["arch_health"] for r in structure.architecture_health(fs).collect()}
    assert health[2] == round(100 * (1 - 0.5 * 13 / 49 - 0.3 * 6 / 7 - 0.2 * 2 / 7), 6)
