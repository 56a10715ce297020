"""Seeded histories: lineage, liveness, buckets, groups and ties."""

from __future__ import annotations

from datetime import datetime

import pytest

from tidemark.operators import churn, coupling, delivery, gates, ownership, rankings, relations
from tidemark.sources.facts import FactStore
from tidemark.sources.options import QueryOptions

COMMITS = "rev string, author_email string, author_name string, committer_email string, canonical_author string, ai_attribution string, date timestamp, committer_date timestamp, message string, is_merge boolean, parent_count int, nf int, seq long"
CHANGES = "rev string, path string, change_type string, rename_from string, loc_added int, loc_deleted int"


def store(spark, commits, changes, aliases=(), **options):
    rows = []
    for k, c in enumerate(commits):
        c = {"author": "Ann <a@x>", "message": "m", "is_merge": False, "seq": len(commits) - 1 - k, "ai": "human", **c}
        at = datetime.fromisoformat(c["date"])
        name, _, mail = c["author"].rstrip(">").partition(" <")
        rows.append((c["rev"], mail, name, mail, c["author"], c["ai"], at, at, c["message"], c["is_merge"], 1, 1, c["seq"]))
    return FactStore(
        spark,
        "/nowhere",
        QueryOptions(**options),
        commits=spark.createDataFrame(rows, COMMITS),
        changes=spark.createDataFrame([(*c, *[None] * (6 - len(c))) for c in changes], CHANGES),
        author_aliases=spark.createDataFrame(list(aliases), "raw_name string, raw_email string, canonical string, is_bot boolean"),
        blobs=spark.createDataFrame([], "path string, lang string, n_bytes long, content string"),
    )


def days(n, month="03"):
    return [{"rev": f"c{k}", "date": f"2026-{month}-{k:02d} 12:00:00"} for k in range(1, n + 1)]


def test_name_retired_twice(spark):
    fs = store(
        spark, days(4), [("c1", "a.rs", "added"), ("c2", "b.rs", "renamed", "a.rs"), ("c3", "a.rs", "added"), ("c4", "c.rs", "renamed", "a.rs")]
    )
    assert relations.lineage_epochs(fs).where("path = 'a.rs'").count() == 2
    assert {(r["rev"], r["path"]) for r in relations.lineage_changes(fs).collect()} == {("c1", "b.rs"), ("c2", "b.rs"), ("c3", "c.rs"), ("c4", "c.rs")}


def test_copies_retire_nothing(spark):
    fs = store(spark, days(2), [("c1", "src.rs", "added"), ("c2", "dup.rs", "copied", "src.rs")])
    assert {r["path"] for r in relations.lineage_changes(fs).collect()} == {"src.rs", "dup.rs"}


@pytest.mark.parametrize(("as_of", "alive"), [("2026-03-02 00:00:00", {"a"}), ("2026-03-04 00:00:00", {"b"}), ("2026-03-06 00:00:00", {"a", "b"})])
def test_renamed_away(spark, as_of, alive):
    commits = [{"rev": "c1", "date": "2026-03-01 12:00:00"}, {"rev": "c2", "date": "2026-03-03 12:00:00"}, {"rev": "c3", "date": "2026-03-05 12:00:00"}]
    fs = store(spark, commits, [("c1", "a", "added"), ("c2", "b", "renamed", "a"), ("c3", "a", "added")], as_of=as_of)
    assert {r["path"] for r in churn.live_paths_at(fs).collect()} == alive


def test_bucket_takes_latest_type(spark):
    fs = store(spark, days(3)[1:], [("c2", "f", "modified"), ("c3", "f", "deleted")], time_bucket="week")
    assert [r["change_type"] for r in relations.bucketed(fs).collect()] == ["deleted"]


def test_same_second_newest_first(spark):
    commits = [{"rev": "zzz_older", "date": "2026-03-01 12:00:00", "seq": 1}, {"rev": "aaa_newer", "date": "2026-03-01 12:00:00", "seq": 0}]
    fs = store(spark, commits, [("zzz_older", "f.rs", "modified"), ("aaa_newer", "f.rs", "modified")])
    assert [r["rev"] for r in delivery.evidence_commits(fs, 2).orderBy("pos").collect()] == ["aaa_newer", "zzz_older"]


def test_groups(spark):
    fs = store(spark, days(1), [("c1", "app/x.rs", "modified", None, 1), ("c1", "apple/y.rs", "modified", None, 2), ("c1", "lib/z.rs", "modified", None, 3)])
    rules = [("app", "A"), ("^li", "L")]
    assert {(r["path"], r["loc_added"]) for r in relations.grouped_changes(fs, rules).collect()} == {("A", 1), ("apple/y.rs", 2), ("L", 3)}
    assert relations.grouped_changes(fs, rules, strict=True).count() == 2


def test_null_and_negative_lines(spark):
    fs = store(spark, days(1), [("c1", "f", "modified", None, None, -4), ("c1", "f", "modified", None, None, -4), ("c1", None, "modified", None, 1, 1)])
    assert [(r["loc_added"], r["loc_deleted"]) for r in fs.changes.collect()] == [(0, 0)]


def test_coupling_thresholds(spark):
    commits = days(12)
    both = [(f"c{k}", p, "modified") for k in range(1, 7) for p in ("a", "b")]
    alone = [(f"c{k}", "z", "modified") for k in range(7, 13)]
    fs = store(spark, commits, both + alone)
    rows = coupling.coupling(fs).collect()
    assert [(r["entity_a"], r["entity_b"], r["shared"], r["degree"]) for r in rows] == [("a", "b", 6, 100.0)]
    assert rows[0]["fisher_p"] == pytest.approx(1 / 924 * 2)
    assert coupling.coupling(fs.with_options(max_changeset_size=1)).count() == 0
    assert coupling.coupling(fs.with_options(min_revs=7)).count() == 0
    assert coupling.coupling(fs.with_options(compat=True, significance=0.0001)).count() == 1


def test_islands_and_authors(spark):
    people = [("Ann", "a@x", "Ann <a@x>", False), ("Bob", "b@x", "Bob <b@x>", False), ("Ci", "ci@x", "Ci <ci@x>", True)]
    commits = [{"rev": f"c{k}", "date": f"2025-01-{k:02d} 12:00:00", "author": "Ann <a@x>"} for k in range(1, 7)] + [
        {"rev": "c7", "date": "2026-04-20 12:00:00", "author": "Bob <b@x>"},
        {"rev": "c8", "date": "2026-04-21 12:00:00", "author": "Ci <ci@x>"},
    ]
    changes = [(f"c{k}", "f", "modified", None, 10, 0) for k in range(1, 7)] + [("c7", "f", "modified", None, 1, 0), ("c8", "f", "modified", None, 500, 0)]
    fs = store(spark, commits, changes, people)
    row = ownership.knowledge_islands(fs).collect()[0]
    assert (row["entity"], row["main_author"], row["total_loc"], row["n_substantial_others"]) == ("f", "Ann <a@x>", 61, 0)
    a = churn.authors(fs).collect()[0]
    assert (a["n_authors"], a["n_humans"], a["n_bots"], a["last_author"]) == (3, 2, 1, "Ci <ci@x>")
    assert sum(r["k_norm"] for r in ownership.knowledge_shares(fs).collect()) == pytest.approx(1.0)


def test_empty_history(spark):
    fs = store(spark, [], [])
    for analysis in (churn.revisions, churn.abs_churn, churn.soc, ownership.ownership, ownership.main_dev, coupling.coupling, ownership.knowledge_shares, relations.lineage_changes, delivery.lead_time):
        assert analysis(fs).count() == 0
    assert {r["value"] for r in churn.summary(fs).collect()} == {0}


def test_gates(spark):
    rows = spark.createDataFrame([("a", 5.0), ("b", 1.0), ("c", None)], "path string, v double")
    found = gates.violations(rows, "g", "v", 3, above=True)
    assert [tuple(r) for r in found.collect()] == [("g", "a", 5.0, 3.0)]
    verdict = {r["gate"]: r["verdict"] for r in gates.verdicts(found, {"g": True, "h": True, "k": False}).collect()}
    assert verdict == {"g": "failed", "h": "passed", "k": "skipped"}
    now = spark.createDataFrame([("m", 1.0), ("n", 5.0)], "metric string, value double")
    was = spark.createDataFrame([("m", 2.0, True), ("n", 5.0, False), ("o", 1.0, True)], "metric string, value double, higher_is_better boolean")
    assert {(r["metric"], r["reason"]) for r in gates.ratchet(now, was).collect()} == {("m", "worse"), ("o", "missing")}


def test_delta_health(spark):
    schema = "path string, base string, loc int, cyclomatic int"
    before = spark.createDataFrame([("f", "x", 80, 1), ("f", "y", 5, 1), ("f", "gone", 5, 1)], schema)
    after = spark.createDataFrame([("f", "x", 10, 1), ("f", "y", 5, 12), ("f", "born", 5, 1)], schema)
    assert {(r["base"], r["outcome"]) for r in delivery.delta_health(before, after).collect()} == {("x", "good"), ("y", "bad"), ("gone", "removed"), ("born", "new")}


def test_szz_has_no_age_limit(spark):
    commits = [{"rev": "old", "date": "2022-01-01 12:00:00"}, {"rev": "near", "date": "2025-12-01 12:00:00"}, {"rev": "fix", "date": "2026-03-01 12:00:00", "message": "fix it"}]
    # regions are derived from counts: of old, lines 3-4 of both; of near, lines 11-16 of b; the fix takes lines 4-6 of a and b
    changes = [("old", "a", "modified", None, 2, 0), ("old", "b", "modified", None, 2, 0), ("near", "b", "modified", None, 10, 0), ("fix", "a", "modified", None, 1, 3), ("fix", "b", "modified", None, 1, 3)]
    assert {tuple(r) for r in delivery.szz_candidates(store(spark, commits, changes)).collect()} == {("fix", "a", "old"), ("fix", "b", "old")}


def test_corpus_lens_takes_the_highest_metric(spark):
    flat = [float(k) for k in range(100)]
    metrics = [(m, flat) for m in ("cognitive", "cyclomatic", "sloc", "max_nesting")] + [("nargs", [0.0, 1.0])]
    schema = "artifact_id string, lang string, sloc_min int, sloc_max int, sample_functions int, metrics array<struct<metric: string, quantiles: array<double>>>"
    strata = spark.createDataFrame([("x", "rust", 0, 99, 600, metrics), ("x", "go", 0, 99, 499, metrics)], schema)
    blobs = spark.createDataFrame([("wide.rs", "rust", 1, "f(a, b, c, d)"), ("thin.go", "go", 1, "f(a, b, c, d)")], "path string, lang string, n_bytes long, content string")
    got = rankings.corpus_lens(store(spark, [], []).replacing(strata=strata, blobs=blobs)).collect()
    assert [(r["path"], r["corpus_percentile"], r["beyond_corpus"]) for r in got] == [("wide.rs", 1.0, True)]
    assert 0.99 < got[0]["ci_low"] < 1.0 and got[0]["ci_high"] == 1.0


def test_options_are_checked():
    for bad in ({"min_coupling_pct": 50.0, "max_coupling_pct": 40.0}, {"window_days": 0}, {"rework_window_days": 400}, {"knowledge_model": "x"}, {"time_bucket": "year"}, {"rows_limit": 0}):
        with pytest.raises(ValueError, match=r"."):
            QueryOptions(**bad)


@pytest.mark.parametrize("least", [1, 2, 5, 9])
def test_shared_counts_against_brute_force(spark, least):
    import random
    from collections import Counter
    from itertools import combinations

    from tidemark.operators.pairs import shared_counts

    rng = random.Random(least)
    rows = {(f"g{k}", f"i{rng.randrange(40)}") for k in range(50) for _ in range(rng.choice([1, 3, 9, 60]))} | {("hot", f"i{k}") for k in range(300)}
    groups: dict = {}
    for g, i in rows:
        groups.setdefault(g, set()).add(i)
    want = Counter(p for items in groups.values() for p in combinations(sorted(items), 2))
    df = spark.createDataFrame(sorted(rows), "g string, i string")
    got = {(r["a"], r["b"]): r["shared"] for r in shared_counts(df, "g", "i", least, block=8).collect()}
    assert got == {p: n for p, n in want.items() if n >= least}
