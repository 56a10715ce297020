"""How many groups two items share, for all pairs that share enough."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import stage_table

_ASIDE = 7


def shared_counts(rows: DataFrame, group: str, item: str, min_shared: int, block: int = 256) -> DataFrame:
    """Pairs ``a`` < ``b`` of items that share at least ``min_shared`` groups: ``a``, ``b``, ``shared``.

    ``rows`` holds distinct pairs of a group and an item. The ``min_shared - 1`` largest groups, seven at
    most, are set aside: a pair in enough groups is in at least one other, so the others give all
    candidates, and each item carries a bit for every set-aside group it is in, from which the rest of
    the count follows. Items in too few groups leave before any pair is made. What is still a large group
    is dealt to the cells of a square, so that no task holds all of it.
    """
    base = rows.select(F.col(group).alias("g"), F.col(item).alias("i"))
    sizes = base.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    aside = [r["g"] for r in sizes.where("n > 1").orderBy(F.desc("n"), "g").limit(min(_ASIDE, min_shared - 1)).collect()]
    flag = F.lit(0)
    for k, g in enumerate(aside):
        flag = F.when(F.col("g") == F.lit(g), 1 << k).otherwise(flag)
    flagged = base.withColumn("flag", flag.cast("long"))
    keys = stage_table(
        flagged.groupBy("i")
        .agg(F.count(F.lit(1)).alias("n"), F.bit_or("flag").alias("mask"))
        .where(F.col("n") >= min_shared)
        .select("i", (F.monotonically_increasing_id() * (1 << _ASIDE) + F.col("mask")).alias("key"))
    )
    cells = sizes.where(F.col("n") > block).select("g", F.ceil(F.col("n") / block).cast("int").alias("cells"))
    members = flagged.where("flag = 0").join(keys, "i").select("g", "key").join(cells, "g", "left").withColumn("cells", F.coalesce("cells", F.lit(1)))
    small = (
        members.where("cells = 1")
        .groupBy("g")
        .agg(F.sort_array(F.collect_list("key")).alias("keys"))  # at most `block` of them
        .where(F.size("keys") > 1)
        .select("keys", F.posexplode("keys").alias("at", "a"))
        .select("a", F.explode(F.slice("keys", F.col("at") + 2, F.size("keys"))).alias("b"))
    )
    dealt = members.where("cells > 1").withColumn("cell", F.pmod(F.xxhash64("key"), "cells").cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
    left = dealt.select("g", F.col("key").alias("a"), F.col("cell").alias("row"), every.alias("col"))
    right = dealt.select("g", F.col("key").alias("b"), F.col("cell").alias("col"), every.alias("row"))
    wide = left.join(right, ["g", "row", "col"]).where("a < b").select("a", "b")
    counted = small.unionByName(wide).groupBy("a", "b").agg(F.count(F.lit(1)).alias("seen"))
    shared = F.col("seen") + F.bit_count(F.col("a").bitwiseAND(F.col("b")).bitwiseAND(F.lit((1 << len(aside)) - 1)))
    enough = counted.select(F.col("a").alias("ka"), F.col("b").alias("kb"), shared.cast("long").alias("shared")).where(F.col("shared") >= min_shared)
    named = enough.join(keys.select(F.col("key").alias("ka"), F.col("i").alias("x")), "ka").join(keys.select(F.col("key").alias("kb"), F.col("i").alias("y")), "kb")
    return named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "shared")


def frequent_pairs(rows: DataFrame, group: str, item: str, min_shared: int, min_part: float, block: int = 12_000) -> DataFrame:
    """Pairs ``a`` < ``b`` of items with at least ``min_shared`` shared groups, and that part of both items' groups together: ``a``, ``b``, ``shared``.

    For groups so large that their pairs cannot be moved. Items are dealt to blocks of about ``block``; a task
    has the groups of two blocks' items as numbers, counts by item in memory, and gives only what is enough.
    Whole items are moved once for each block, pairs below the thresholds never.
    """
    base = rows.select(F.col(group).alias("g"), F.col(item).alias("i"))
    numbered = stage_table(base.select("g").distinct().withColumn("gid", F.monotonically_increasing_id()))
    held = base.join(numbered, "g").groupBy("i").agg(F.collect_list("gid").alias("gids")).where(F.size("gids") >= min_shared)
    items = stage_table(held.withColumn("id", F.monotonically_increasing_id()))
    blocks = max(1, -(-items.count() // block))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    # each item goes to every cell of the triangle that its block is part of
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = items.select("id", "gids", own.alias("own")).withColumn("other", other)
    cells = dealt.select((F.least("own", "other") * blocks + F.greatest("own", "other")).alias("cell"), "own", "id", "gids")

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = divmod(int(key[0]), blocks)
        return _enough(pdf[pdf["own"] == low], pdf[pdf["own"] == high], low == high, min_shared, min_part)

    counted = cells.groupBy("cell").applyInPandas(count, "ka long, kb long, shared long")
    named = counted.join(items.select(F.col("id").alias("ka"), F.col("i").alias("x")), "ka").join(items.select(F.col("id").alias("kb"), F.col("i").alias("y")), "kb")
    return named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "shared")


def _enough(left: pd.DataFrame, right: pd.DataFrame, same: bool, min_shared: int, min_part: float) -> pd.DataFrame:
    """Pairs of an item of one table with one of the other that share enough groups; within one table each pair once."""
    ids, sizes = right["id"].to_numpy(), np.array([len(g) for g in right["gids"]], dtype=np.int64)
    none = pd.DataFrame({"ka": [], "kb": [], "shared": []}, dtype="int64")
    if not len(left) or not len(right):
        return none
    groups = np.concatenate(list(right["gids"]))
    order = np.argsort(groups, kind="stable")
    places = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)[order]
    known, starts = np.unique(groups[order], return_index=True)
    posting = dict(zip(known.tolist(), np.split(places, starts[1:]), strict=True))
    out = []
    for k, (mine, gids) in enumerate(zip(left["id"].to_numpy(), left["gids"], strict=True)):
        met = [posting[g] for g in gids.tolist() if g in posting]
        if not met:
            continue
        shared = np.bincount(np.concatenate(met), minlength=len(ids))
        if same:
            shared[: k + 1] = 0
        hits = np.flatnonzero(shared >= min_shared)
        hits = hits[shared[hits] >= min_part * (len(gids) + sizes[hits]) * (1 - 1e-12)]
        if len(hits):
            out.append(pd.DataFrame({"ka": mine, "kb": ids[hits], "shared": shared[hits].astype("int64")}))
    return pd.concat(out) if out else none
