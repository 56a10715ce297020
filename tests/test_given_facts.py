"""Facts that are given as tables, caps that are gone, and staged tables that are left behind."""

from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.test_relations import days, store
from tidemark.functions.stats import benjamini_hochberg, count_below, roc_auc
from tidemark.operators import churn, coupling, delivery, rankings, snapshots, structure
from tidemark.session import drop_staged, settled, stage_table, staged_tables
from tidemark.sources import readers, sinks

HUNKS = "rev string, path string, old_start int, old_lines int, new_start int, new_lines int"
PARENTS = "rev string, parent_rev string, position int"
MEASURED = "path string, name string, rev string, cyclomatic int, cognitive int, mi double, loc int, sloc int, max_nesting int, nargs int, bool_ops int"
ENTITIES = "path string, name string, kind string, start_line int, end_line int, rev_introduced string, rev_last_seen string"


def test_given_hunks_and_functions(spark):
    fs = store(spark, days(4), [(f"c{k}", "f.py", "modified", None, 3, 1) for k in range(1, 5)], min_revs=2)
    hunks = [("c1", "f.py", 2, 1, 2, 1), ("c2", "f.py", 3, 1, 3, 2), ("c3", "f.py", 12, 3, 12, 0), ("c4", "f.py", 30, 1, 30, 1), ("c4", "f.py", 30, 1, 30, 1)]
    entities = [("f.py", "one@1-5", "function", 1, 5, "c1", "c4"), ("f.py", "two@10-14", "function", 10, 14, "c1", "c4"), ("f.py", "f.py", "unit", 1, 40, "c1", "c4")]
    measured = [("f.py", "one@1-5", "c4", 3, 2, 80.0, 5, 5, 1, 1, 0), ("f.py", "two@10-14", "c4", 9, 8, 60.0, 5, 4, 2, 3, 1), ("f.py", "f.py", "c4", 12, 10, 55.5, 40, 33, 2, 3, 1)]
    fs = fs.replacing(hunks=spark.createDataFrame(hunks, HUNKS), entities=spark.createDataFrame(entities, ENTITIES), complexity_metrics=spark.createDataFrame(measured, MEASURED))
    touched = {(r["rev"], r["name"]) for r in coupling.touched_functions(fs).collect()}
    assert touched == {("c1", "one@1-5"), ("c2", "one@1-5"), ("c3", "two@10-14")}
    assert [(r["path"], r["function"], r["revs"]) for r in rankings.function_hotspots(fs).collect()] == [("f.py", "one@1-5", 2)]
    one = fs.files.collect()[0]
    assert (one["lang"], one["sloc"], one["cognitive"], one["mi"]) == ("py", 33, 10, 55.5)


def test_given_parents_and_branches(spark):
    """A branch of one commit over 26 hours whose merge lands on the main line."""
    commits = [
        {"rev": "m1", "date": "2026-03-01 00:00:00"},
        {"rev": "b1", "date": "2026-03-01 10:00:00"},
        {"rev": "m2", "date": "2026-03-01 12:00:00"},
        {"rev": "mg", "date": "2026-03-02 12:00:00", "is_merge": True},
    ]
    parents = [("m2", "m1", 0), ("b1", "m1", 0), ("mg", "m2", 0), ("mg", "b1", 1)]
    fs = store(spark, commits, [("m1", "a", "added", None, 1, 0), ("b1", "x", "added", None, 4, 0), ("m2", "a", "modified", None, 1, 1)]).replacing(commit_parents=spark.createDataFrame(parents, PARENTS))
    assert {r["rev"] for r in delivery.mainline(fs).collect()} == {"m1", "m2", "mg"}
    assert {tuple(r) for r in delivery.branch_commits(fs).collect()} == {("mg", "b1")}
    got = {r["metric"]: (r["p50"], r["n"], r["caveat"] is not None) for r in delivery.delivery_metrics(fs).collect()}
    assert got["branch_duration_hours"] == (26.0, 1, True) and got["batch_size_files"] == (1.0, 1, True) and got["batch_size_loc"] == (4.0, 1, True)


def test_branch_of_many_steps(spark):
    n = 230
    commits = [{"rev": "m1", "date": "2026-03-01 00:00:00"}, *[{"rev": f"b{k}", "date": f"2026-03-02 {k // 60:02d}:{k % 60:02d}:00"} for k in range(n)], {"rev": "mg", "date": "2026-03-03 00:00:00", "is_merge": True}]
    parents = [("b0", "m1", 0), *[(f"b{k}", f"b{k - 1}", 0) for k in range(1, n)], ("mg", "m1", 0), ("mg", f"b{n - 1}", 1)]
    fs = store(spark, commits, [("m1", "a", "added")]).replacing(commit_parents=spark.createDataFrame(parents, PARENTS))
    assert {r["rev"] for r in delivery.branch_commits(fs).collect()} == {f"b{k}" for k in range(n - 200, n)}


def test_given_tags_imports_and_clones(spark):
    tags = spark.createDataFrame([("v1", "c1", datetime(2026, 3, 1)), ("v2", "c2", datetime(2026, 3, 11)), ("x", "c2", datetime(2026, 3, 12))], "name string, target_rev string, date timestamp")
    imports = spark.createDataFrame([("c1", "a", "b", True, "b", "relative"), ("c1", "b", "a", True, "a", "relative"), ("c1", "a", "zip", False, None, "absolute")], "rev string, src_path string, target string, resolved boolean, target_path string, kind string")
    clones = spark.createDataFrame([(1, b"x", "a", "f", 1, 9, 40, 1.0), (1, b"x", "b", "g", 3, 11, 40, 1.0)], "clone_group_id int, fingerprint binary, path string, function string, start_line int, end_line int, node_count int, similarity double")
    fs = store(spark, days(2), [("c1", "a", "added"), ("c2", "b", "added")]).replacing(tags=tags, imports=imports, clones=clones)
    assert [tuple(r) for r in delivery.release_cadence(fs).orderBy("date").collect()] == [("v1", "2026-03-01", None), ("v2", "2026-03-11", 10)]
    assert {r["path"] for r in structure.dependency_cycles(fs).collect()} == {"a", "b"}
    assert [r["family_size"] for r in rankings.clones(fs).collect()] == [2, 2]


def test_lineage_is_an_option_of_the_store(spark):
    rows = [("c1", "a.rs", "added"), ("c2", "b.rs", "renamed", "a.rs"), ("c3", "b.rs", "modified")]
    assert {tuple(r) for r in churn.revisions(store(spark, days(3), rows, min_revs=1)).collect()} == {("a.rs", 1), ("b.rs", 2)}
    assert {tuple(r) for r in churn.revisions(store(spark, days(3), rows, min_revs=1, lineage=True)).collect()} == {("b.rs", 3)}


def test_the_last_commit_is_the_anchor(spark):
    fs = store(spark, [*days(2), {"rev": "late", "date": "2999-01-01 00:00:00"}], [("c1", "a", "added")])
    assert store(spark, days(2), [("c1", "a", "added")]).moment == datetime(2026, 3, 2, 12)
    assert fs.moment.year < 2999


def test_extraction_is_tried(spark):
    import pandas as pd

    # two rings that share "hub"; "busy" has most links but leaves a ring behind
    ring = [("hub", "a"), ("a", "hub"), ("hub", "b"), ("b", "c"), ("c", "hub")]
    frame = pd.DataFrame([(7, *e) for e in ring], columns=["cycle_id", "src_path", "target_path"])
    assert structure._extraction(frame).iloc[0].tolist() == [7, "hub"]


@pytest.mark.parametrize("by", [[], ["g"]])
def test_ranks_without_one_window_over_all_values(spark, by):
    rng = random.Random(5)
    rows = [("x" if rng.random() < 0.7 else "y", rng.choice([0.0, -1.5, rng.gauss(0, 1e3), rng.random() * 1e-9, float(rng.randrange(5))])) for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r["g"], r["v"]): r["r"] for r in rankings.percent_ranked(df, "v", "r", by).collect()}
    for g, v in rows:
        same = [w for h, w in rows if not by or h == g]
        assert got[g, v] == pytest.approx(sum(w < v for w in same) / (len(same) - 1))
    assert count_below(df.groupBy("v").agg(F.count("*").alias("n")), "v", "n").count() == len({v for _, v in rows})


def test_fdr_and_auc(spark):
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205, 0.001, None]
    df = spark.createDataFrame([(x,) for x in p], "p double")
    known = sorted(x for x in p if x is not None)
    cut = max(x for k, x in enumerate(known, 1) if x <= k / len(known) * 0.05)
    assert sorted(r["p"] for r in benjamini_hochberg(df, "p", 0.05).collect()) == [x for x in known if x <= cut]
    scored = spark.createDataFrame([(1.0, False), (2.0, True), (2.0, False), (3.0, True)], "s double, y boolean")
    assert roc_auc(scored, "s", "y").collect()[0]["auc"] == pytest.approx(3.5 / 4)


def test_attribution(spark):
    rows = [
        ("dependabot[bot]", "x@y", "m", "ai-authored"),
        ("Ann", "noreply@github.com", "m", "human"),
        ("Ann", "a@x", "m\n\nCo-authored-by: Claude <c@x>", "ai-assisted"),
        ("Ann", "a@x", "m\n\nCo-Authored-By: Cursor Agent <c@x>", "ai-assisted"),
        ("Ann", "a@x", "m\n\nCo-authored-by: Claude Dubois <c@x>", "human"),
        ("Ann", "a@x", "m\n\nCo-authored-by: renovate[bot] <c@x>", "ai-assisted"),
        ("Ann (aider)", "a@x", "work (aider)", "ai-assisted"),
        (None, None, None, "human"),
    ]
    df = spark.createDataFrame(rows, "n string, e string, m string, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", readers.attribution(F.col("n"), F.col("e"), F.col("m")).alias("got")).collect())


def test_mailmap_and_ignore_file(spark, tmp_path):
    (tmp_path / "map").write_text("Ann Lee <ann@x> # home\n<bo@x> <bo@old>\nCy Dee <cy@x> Cyd <shared@x>\n")
    commits = spark.createDataFrame([("Annie", "ann@x"), ("Bo", "BO@old"), ("cyd", "shared@x"), ("Di", "shared@x")], "author_name string, author_email string")
    got = readers.apply_mailmap(commits, readers.read_mailmap(spark, str(tmp_path / "map")))
    assert {r["canonical_author"] for r in got.collect()} == {"Ann Lee <ann@x>", "Bo <bo@x>", "Cy Dee <cy@x>", "Di <shared@x>"}
    (tmp_path / "ignore").write_text("# none\n*.lock\n\n")
    assert readers.read_ignore(str(tmp_path / "ignore")) == ["*.lock"]


def test_reports_say_what_they_leave_out(spark, tmp_path):
    df = spark.range(5).select(F.concat(F.lit("f"), "id").alias("path"), F.col("id").cast("double").alias("cognitive_health"))
    with pytest.raises(ValueError, match="more than 3"):
        sinks.to_json_array(df, 3)
    assert "Only the first 3" in sinks.to_sarif(df, "r", limit=3) and "Only the first" not in sinks.to_sarif(df, "r", limit=5)
    assert len(sinks.to_annotations(df, "t", limit=3)) == 4 and len(sinks.to_annotations(df, "t")) == 5
    assert "The first 2 rows" in sinks.to_step_summary("s", {"files": df}, 2) and "The first 2 rows" in sinks.to_html(df, "<t>", 2)
    sinks.write_dashboard({"files": df}, str(tmp_path / "board"))
    assert spark.read.json(str(tmp_path / "board/files")).count() == 5 and spark.read.json(str(tmp_path / "board/index")).count() == 1


def test_diff_gates(spark):
    report = spark.createDataFrame([("a", 80.0, 60.0, -20.0, True)], "path string, health_before double, health_after double, delta double, newly_cyclic boolean")
    hot = spark.createDataFrame([("a", "entered"), ("b", "rose")], "path string, reason string")
    delta = spark.createDataFrame([("p", "f", "bad", 70), ("p", "g", "good", 30)], "path string, base string, outcome string, weight long")
    limits = {"delta_code_health_min": -5, "no_new_cycles": 1, "new_hotspot_max": 0, "delta_health_min": 50, "deny_degrading_verdict": 1}
    assert {r["gate"] for r in snapshots.diff_gates(report, limits, hot, delta).collect()} == set(limits)


def test_operators_leave_one_table(spark):
    drop_staged(*staged_tables())

    @settled
    def work(df):
        return stage_table(stage_table(df).where("id > 1")).where("id > 2")

    out = work(spark.range(5))
    assert out.count() == 2 and len(staged_tables()) == 1
    drop_staged(out)
    assert not staged_tables()
