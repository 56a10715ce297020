"""Queries of the rename hierarchy (problem 7) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.hierarchy import descendants, resolve_hierarchy
from tidemark.session import read_table


def rename_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rename and copy links of the change table, older to newer path."""
    return (
        read_table(spark, sf_dir, "changes")
        .where(F.col("change_type").isin("renamed", "copied") & (F.col("rename_from") != "") & F.col("path").isNotNull())
        .select("path", "rename_from")
    )


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path of a link with its oldest ancestor and the number of links from there."""
    found = resolve_hierarchy(rename_links(spark, sf_dir), "path", "rename_from")
    return found.select(F.col("node").alias("path"), "root", "depth")


def p7_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path of a link with its chain of ancestors, nearest first, and the chain's length."""
    found = resolve_hierarchy(rename_links(spark, sf_dir), "path", "rename_from", with_chain=True)
    return found.select(F.col("node").alias("path"), "root", "depth", F.concat_ws(" <- ", "chain").alias("ancestors"))


def p7_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All descendants of every path, one row each, with the number of links between them."""
    found = resolve_hierarchy(rename_links(spark, sf_dir), "path", "rename_from", with_chain=True)
    return descendants(found).select(F.col("ancestor").alias("path"), F.col("node").alias("descendant"), "distance")


_WALK = """
WITH RECURSIVE links AS (
  SELECT path AS node, min(rename_from) AS up FROM changes
  WHERE change_type IN ('renamed','copied') AND rename_from IS NOT NULL AND rename_from <> '' AND path IS NOT NULL
  GROUP BY path),
nodes AS (SELECT node FROM links UNION SELECT up FROM links),
roots AS (SELECT n.node FROM nodes n LEFT JOIN links l ON l.node = n.node WHERE l.node IS NULL),
walk AS (
  SELECT node, node AS root, 0::BIGINT AS depth, '' AS ancestors FROM roots
  UNION ALL
  SELECT l.node, w.root, w.depth + 1, CASE WHEN w.depth = 0 THEN w.node ELSE w.node || ' <- ' || w.ancestors END
  FROM walk w JOIN links l ON l.up = w.node)
"""

QUERIES = {"p7_found": p7_found, "p7_chains": p7_chains, "p7_descendants": p7_descendants}

SQL = {
    "p7_found": _WALK
    + "SELECT n.node AS path, coalesce(w.root, '') AS root, coalesce(w.depth, -1) AS depth FROM nodes n LEFT JOIN walk w ON w.node = n.node",
    "p7_chains": _WALK
    + "SELECT n.node AS path, coalesce(w.root, '') AS root, coalesce(w.depth, -1) AS depth, coalesce(w.ancestors, '') AS ancestors FROM nodes n LEFT JOIN walk w ON w.node = n.node",
    "p7_descendants": """
WITH RECURSIVE links AS (
  SELECT path AS node, min(rename_from) AS up FROM changes
  WHERE change_type IN ('renamed','copied') AND rename_from IS NOT NULL AND rename_from <> '' AND path IS NOT NULL
  GROUP BY path),
nodes AS (SELECT node FROM links UNION SELECT up FROM links),
ok AS (
  SELECT n.node FROM nodes n LEFT JOIN links l ON l.node = n.node WHERE l.node IS NULL
  UNION ALL SELECT l.node FROM ok JOIN links l ON l.up = ok.node),
walk AS (
  SELECT l.node AS descendant, l.up AS path, 1::BIGINT AS distance FROM links l JOIN ok ON ok.node = l.node
  UNION ALL
  SELECT w.descendant, l.up, w.distance + 1 FROM walk w JOIN links l ON l.node = w.path)
SELECT path, descendant, distance FROM walk""",
}
