"""Registered training-data queries on the smallest tables, against SQL where there is one."""

from __future__ import annotations

from pathlib import Path

import pytest

from tests.compare import difference, oracle
from tidemark.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, name):
    assert difference(spark, oracle(SF), queries.QUERIES[name], queries.SQL[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("p1_found", "path_a string, path_b string"),
        ("p2_found", "path string, author string, pos bigint"),
        ("p4_found", "author_a string, author_b string"),
        ("p6_found", "path string"),
        ("p9_found", "doc_id bigint, item_id bigint"),
        ("p10_found", "doc_a bigint, doc_b bigint"),
    ],
)
def test_columns(spark, name, columns):
    assert ", ".join(" ".join(c) for c in queries.QUERIES[name](spark, SF).dtypes) == columns


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p3_commit_la", "p4_found", "p5_ranking", "p6_found", "p8_containers", "p10_found"])
def test_one_staged_table_at_most_is_left(spark, name):
    from tidemark.session import drop_staged, staged_tables

    drop_staged(*staged_tables())
    df = queries.QUERIES[name](spark, SF)
    assert df.count() > 0 and len(staged_tables()) <= 1
