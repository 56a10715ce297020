"""Places in a total order, counted without gathering the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import stage_table

_INSIDE = 33  # bits that monotonically_increasing_id() gives to the row inside its partition


def place_rows(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``place`` (1, 2, ...) in a total order, numbered partition by partition."""
    ordered = stage_table(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    inside = F.col("_at").bitwiseAND(F.lit((1 << _INSIDE) - 1))
    part = F.shiftright("_at", _INSIDE)
    # one row per partition of the sort
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    return (
        ordered.withColumn("_part", part)
        .join(offsets, "_part")
        .withColumn("place", (F.col("_before") + inside + 1).cast("long"))
        .drop("_part", "_before", "_at")
    )
