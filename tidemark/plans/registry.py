"""All registered queries of the core."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import churn_queries, coupling_queries, delivery_queries, hierarchy_queries, ownership_queries, ranking_queries, snapshot_queries, structure_queries
from tidemark.session import drop_staged, settled, stage_table
from tidemark.sources.facts import FactStore
from tidemark.sources.options import QueryOptions

AS_OF = "2026-05-01 00:00:00"
_FAMILIES = [churn_queries, ownership_queries, coupling_queries, ranking_queries, structure_queries, delivery_queries, snapshot_queries]


def _query(analysis: Callable[[FactStore], DataFrame], options: dict) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # the registered queries look back from a fixed day, so that their SQL does not depend on the clock
        fs = FactStore(spark, sf_dir, QueryOptions(**{"as_of": AS_OF, **options}))
        out = settled(analysis)(fs)
        if not fs.keeps:
            return out
        result = stage_table(out)
        fs.close()
        if hasattr(out, "staged_path"):
            drop_staged(out)
        return result

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**hierarchy_queries.QUERIES}
SQL: dict[str, str] = {**hierarchy_queries.SQL}
for _family in _FAMILIES:
    QUERIES.update({name: _query(*made) for name, made in _family.ANALYSES.items()})
    SQL.update(_family.SQL)
