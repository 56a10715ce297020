"""Every registered core query against its SQL counterpart on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

from tests.compare import difference, oracle
from tidemark.plans import registry

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
#: What the smallest tables have no case of.
RARE = {"clone_coupling", "change_set_report", "cycle_health", "cycle_origins", "dependency_cycles", "god_classes"}
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(spark, con, name):
    if name in RARE:
        assert difference(spark, oracle(LARGER), registry.QUERIES[name], registry.SQL[name], LARGER) == ""
    else:
        assert difference(spark, con, registry.QUERIES[name], registry.SQL[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, LARGER if name in RARE else SF)
    assert df.columns and df.count() > 0


def test_sql_belongs_to_queries():
    assert set(registry.SQL) <= set(registry.QUERIES)
