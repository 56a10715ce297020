"""Full hierarchies from parent-child rows by pointer doubling.

Every node starts with a pointer to its parent. In each round an unresolved node takes over the pointer
of the node it points to, so the jump doubles and a chain of depth ``d`` is resolved after ``log2(d)``
rounds; the path segments gathered on the way are concatenated. A chain that ends has nodes at each of
its depths, therefore some node resolves in every round as long as a finite chain is left: the first
round without progress proves that all nodes still unresolved lead into a cycle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import drop_staged, stage_table


def resolve_hierarchy(links: DataFrame, child: str, parent: str, with_chain: bool = False) -> DataFrame:
    """Root, depth and, on request, the chain of ancestors of every node.

    ``links`` holds one row per parent-child link; other columns are ignored, whatever their names.
    Result: ``node``, ``root``, ``depth`` and, with ``with_chain``, ``chain`` (ancestors from the parent
    to the root).

    Defined cases: links with a null end are no links; repeated links count once; a child with several
    parents keeps the smallest one; a node without a parent is its own root at depth 0; a node whose
    ancestors never end (a cycle, or a chain into one) has root ``''``, depth -1 and, with ``with_chain``,
    a null chain. No links give no rows.

    Skew: a parent of very many children is a hot key only on the probe side of the round's join, where
    the adaptive skew join splits it; the build side has one row per node.
    """
    edges = (
        links.select(F.col(child).cast("string").alias("node"), F.col(parent).cast("string").alias("up"))
        .where("node is not null and up is not null")
        .groupBy("node")
        .agg(F.min("up").alias("up"))
    )
    # one row per node; a root points at itself with a jump of 0
    nodes = (
        edges.select("node", "up")
        .unionByName(edges.select(F.col("up").alias("node"), F.lit(None).cast("string").alias("up")))
        .groupBy("node")
        .agg(F.max("up").alias("up"))
    )
    start = nodes.select(
        "node",
        F.coalesce("up", "node").alias("ptr"),
        F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("jump"),
        F.col("up").isNull().alias("done"),
        *([F.when(F.col("up").isNull(), F.array().cast("array<string>")).otherwise(F.array("up")).alias("chain")] if with_chain else []),
    )
    table = stage_table(start)
    open_nodes = table.where("not done").count()
    while open_nodes:
        # what the pointed-at node knows; `done` there means that its pointer is a root
        far = table.select(
            F.col("node").alias("ptr"),
            F.col("ptr").alias("far_ptr"),
            F.col("jump").alias("far_jump"),
            F.col("done").alias("far_done"),
            *([F.col("chain").alias("far_chain")] if with_chain else []),
        )
        moved = (
            table.where("not done")
            .join(far, "ptr")
            .select(
                "node",
                F.col("far_ptr").alias("ptr"),
                (F.col("jump") + F.col("far_jump")).alias("jump"),
                F.col("far_done").alias("done"),
                *([F.concat("chain", "far_chain").alias("chain")] if with_chain else []),
            )
        )
        following = stage_table(table.where("done").unionByName(moved))
        still_open = following.where("not done").count()
        drop_staged(table)
        table = following
        if still_open == open_nodes:
            break
        open_nodes = still_open
    return table.select(
        "node",
        F.when(F.col("done"), F.col("ptr")).otherwise(F.lit("")).alias("root"),
        F.when(F.col("done"), F.col("jump")).otherwise(F.lit(-1)).cast("long").alias("depth"),
        *([F.when(F.col("done"), F.col("chain")).alias("chain")] if with_chain else []),
    )


def descendants(resolved: DataFrame) -> DataFrame:
    """All ancestor-descendant pairs, with their distance, from a resolved hierarchy with chains.

    Result: ``ancestor``, ``node``, ``distance``. Nodes that lead into a cycle have no finite chain and
    give no pairs.
    """
    return resolved.where("depth > 0").select(
        F.col("node"), F.posexplode("chain").alias("position", "ancestor")
    ).select("ancestor", "node", (F.col("position") + 1).cast("long").alias("distance"))
