from __future__ import annotations

import json

import pytest
from pyspark.errors import PySparkException

from tidemark.sources import readers, sinks
from tidemark.sources.options import QueryOptions
from tidemark.streaming import velocity


def test_history(spark, tmp_path):
    commits = [
        {"rev": "r1", "date": "2026-01-01T10:00:00Z", "is_merge": False, "seq": 1, "changes": [{"path": "a", "change_type": "modified", "loc_added": 2, "hunks": [{"old_start": 1, "old_lines": 1, "new_start": 1, "new_lines": 3}]}]},
        {"rev": "r2", "date": "2026-01-03T10:00:00Z", "is_merge": True, "seq": 0, "changes": [{"path": "b", "change_type": "added"}]},
    ]
    file = tmp_path / "h.jsonl"
    file.write_text("\n".join(map(json.dumps, commits)))
    got = readers.read_history(spark, str(file))
    assert got["commits"].count() == 2 and got["hunks"].count() == 1
    assert [tuple(r) for r in got["changes"].collect()] == [("r1", "a", "modified", None, 2, 0)]
    assert readers.read_history(spark, str(file), before="2026-01-01")["commits"].count() == 1
    assert readers.read_history(spark, str(file), include_merges=False)["commits"].count() == 1
    file.write_text(json.dumps({"rev": "r", "changes": [{"path": "a", "change_type": "odd"}]}))
    with pytest.raises(PySparkException):
        readers.read_history(spark, str(file))["changes"].collect()


def test_exclusion(spark):
    rows = spark.createDataFrame([(p,) for p in ("a/.git/x", "src/a.rs", "src/gen/a.rs", "x/gen/b.rs", "docs/a.md", None)], "path string")
    kept = {r["path"] for r in readers.exclude_paths(rows, ["gen/", "docs/*.md", "# note", ""]).collect()}
    assert kept == {"src/a.rs", None}


def test_team_map(spark, tmp_path):
    file = tmp_path / "t.csv"
    file.write_text("author,team\nAnn <a@x>,core\n")
    commits = spark.createDataFrame([("r1", "Ann <a@x>"), ("r2", "Bob <b@x>")], "rev string, canonical_author string")
    assert {r["canonical_author"] for r in readers.fold_teams(commits, readers.read_team_map(spark, str(file))).collect()} == {"core", "Bob <b@x>"}
    for bad in ("name,team\nx,y", "author,team\n,core", "author,team\na,b\na,c", "author,team\nabc"):
        file.write_text(bad)
        with pytest.raises(ValueError, match="team map"):
            readers.read_team_map(spark, str(file))


def test_groups_layers_thresholds(tmp_path):
    file = tmp_path / "f"
    file.write_text("# c\nsrc/a => A\n^lib => L\n")
    assert readers.read_groups(str(file)) == [("src/a", "A"), ("^lib", "L")]
    file.write_text("bad line")
    with pytest.raises(ValueError, match="line 1"):
        readers.read_groups(str(file))
    file.write_text('[layer.a]\npaths = ["x"]\nmay_depend_on = ["b"]\n')
    with pytest.raises(ValueError, match="undeclared"):
        readers.read_layers(str(file))
    file.write_text('[layer.a]\npaths = ["x"]\n[layer.b]\npaths = ["y"]\nmay_depend_on = ["a"]\n')
    assert readers.read_layers(str(file)) == {"a": (["x"], []), "b": (["y"], ["a"])}
    file.write_text("[gates]\ncognitive_max = 4\nflag = true\n")
    assert readers.read_thresholds(str(file)) == {"cognitive_max": 4.0}


def test_sarif_and_findings(spark, tmp_path):
    run = {"tool": {"driver": {"name": "scan", "version": "1"}}, "results": [
        {"ruleId": "r", "message": {"text": "m"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "a.py"}, "region": {"startLine": 3}}}], "partialFingerprints": {"p": "f1"}},
        {"ruleId": "q", "level": "error", "message": {"text": "n"}},
    ]}
    file = tmp_path / "s.json"
    file.write_text(json.dumps({"version": "2.1.0", "runs": [run]}))
    found = readers.read_sarif(spark, str(file))
    rows = {r["rule_id"]: r for r in found.collect()}
    assert (rows["r"]["path"], rows["r"]["end_line"], rows["r"]["level"], rows["r"]["fingerprint"]) == ("a.py", 3, "warning", "f1")
    assert rows["q"]["path"] is None and len(rows["q"]["fingerprint"]) == 64
    out = str(tmp_path / "findings")
    sinks.write_findings(found, out)
    sinks.write_findings(found.where("rule_id = 'q'"), out)
    assert spark.read.parquet(out).count() == 1
    other = found.selectExpr("'other' as engine", *found.columns[1:])
    assert readers.replace_engine(other.unionByName(found), found.limit(1)).count() == 3


def test_calibration(spark, tmp_path):
    art = {"format_version": 1, "corpus_vintage": "v", "languages": [{"language": "go", "sample_functions": 9, "strata": [{"sloc_min": 0, "sloc_max": 5, "metrics": [{"metric": "cognitive", "quantiles": [0.0, 1.0]}]}]}]}
    file = tmp_path / "c.json"
    file.write_text(json.dumps(art))
    r = readers.read_calibration(spark, str(file)).collect()[0]
    assert (r["lang"], r["sample_functions"], r["sloc_max"], r["metrics"][0]["quantiles"]) == ("go", 9, 5, [0.0, 1.0])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("=x", 1.0, None), ("a|b", 90.0, "n")], "path string, cognitive_health double, note string")
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert {r["path"] for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()} == {"'=x", "a|b"}
    sinks.write_ndjson(df, str(tmp_path / "nd"))
    sinks.write_parquet(df, str(tmp_path / "pq"))
    sinks.write_store({"t": df}, str(tmp_path / "st"))
    assert spark.read.parquet(str(tmp_path / "st/t.parquet")).count() == spark.read.json(str(tmp_path / "nd")).count() == 2
    assert json.loads(sinks.to_json_array(df))[0] == {"path": "=x", "cognitive_health": 1.0}
    assert "a\\|b" in sinks.to_markdown(df) and "first 1 rows" in sinks.to_markdown(df, 1)
    report = json.loads(sinks.to_sarif(df, "hot"))
    assert [r["level"] for r in report["runs"][0]["results"]] == ["error", "note"]
    assert sinks.to_annotations(df, "t")[0].startswith("::error file==x,title=t::health 1.0")
    sinks.write_provenance(str(tmp_path / "p.json"), QueryOptions(), engine="1")
    assert json.loads((tmp_path / "p.json").read_text())["options"]["min_revs"] == 5
    for _ in range(2):
        sinks.append_ledger(spark.createDataFrame([("g", "passed")], "gate string, verdict string"), str(tmp_path / "ledger"), "abc", "now")
    assert spark.read.json(str(tmp_path / "ledger")).count() == 2


def test_streaming(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rows = [{"rev": f"r{k}", "path": "a", "canonical_author": "Ann", "date": f"2026-01-0{k}T00:00:00Z", "loc_added": k} for k in (1, 2, 2)]
    rows.append({"rev": "late", "path": "z", "canonical_author": "Ann", "date": "2026-06-01T00:00:00Z", "loc_added": 1})
    (source / "a.json").write_text("\n".join(map(json.dumps, rows)))
    stream = velocity.windowed_velocity(velocity.distinct_changes(velocity.change_stream(spark, str(source))), "30 days", "30 days", None)
    velocity.append_to(stream, str(tmp_path / "out"), str(tmp_path / "chk")).awaitTermination()
    (source / "b.json").write_text(json.dumps({**rows[-1], "rev": "later", "date": "2026-09-01T00:00:00Z"}))
    velocity.append_to(stream, str(tmp_path / "out"), str(tmp_path / "chk")).awaitTermination()
    got = {(r["path"], r["revisions"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert ("a", 2) in got
