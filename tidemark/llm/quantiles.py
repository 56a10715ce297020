"""Exact percentiles of very large columns by bisection, and partial results that can be joined.

Rows are first combined to one weight per group and value, map-side. An interval that contains the wanted
rank is kept per group and percentile. Each pass counts the rows between the midpoints of several levels
of bisection at once (``fanout`` parts), keeps the part with the wanted rank and shrinks it to the values
that occur in it. An interval of a single value is the answer. Both ends of an interval are values that
occur and fall into different parts, therefore every pass narrows.

A percentile ``p`` of total weight ``W`` is the smallest value whose cumulative weight is at least
``p/100 * W`` (nearest rank); no value is interpolated.

Partial results: :func:`partial_counts` reduces a portion (a day, a partition) to counts of values rounded
to ``bits`` significant bits, :func:`merge_partials` adds portions up, and the percentiles of the merged
counts differ from the exact ones by at most ``2**(1 - bits)`` of the value. Exact counts
(``bits=None``) merge without error.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import settled, stage_table

BITS = 9
#: Largest relative error of percentiles of merged partial counts of 9 bits.
ERROR_BOUND = 2.0 ** (1 - BITS)


def _usable(df: DataFrame, value: str) -> DataFrame:
    kept = df.where(F.col(value).isNotNull())
    return kept.where(~F.isnan(value)) if dict(df.dtypes)[value] in ("double", "float") else kept


def _by_magnitude(value: Column) -> Column:
    """A scale that grows with the logarithm of the magnitude on either side of 0, over all doubles."""
    return F.signum(value) * F.when(value == 0, 0.0).otherwise(F.log(F.abs(value)) + 746.0)


def _rounded(value: Column, bits: int) -> Column:
    """The value cut to so many significant binary digits, towards zero."""
    size = F.abs(value.cast("double"))
    step = F.pow(F.lit(2.0), F.floor(F.log2(size)) - (bits - 1))
    return F.when(size < 2.0 ** (bits - 1), F.when(value == F.rint(value), value.cast("double")).otherwise(F.signum(value) * F.floor(size / step) * step)).otherwise(
        F.signum(value) * F.floor(size / step) * step
    )


def partial_counts(df: DataFrame, groups: Sequence[str], value: str, weight: str | None = None, bits: int | None = BITS) -> DataFrame:
    """Combined weights of one portion: the group columns, ``v`` and ``w``.

    Null and NaN values and rows without positive weight are left out. ``bits=None`` keeps values exact.
    """
    kept = _usable(df, value)
    w = F.count(F.lit(1)) if weight is None else F.sum(weight)
    if weight is not None:
        kept = kept.where(F.col(weight) > 0)
    v = F.col(value) if bits is None else F.when(F.col(value) == 0, F.lit(0.0)).otherwise(_rounded(F.col(value), bits))
    made = kept.select(*groups, v.alias("v"), *([F.col(weight)] if weight else []))
    return made.groupBy(*groups, "v").agg(w.cast("long").alias("w"))


def merge_partials(portions: Sequence[DataFrame], groups: Sequence[str]) -> DataFrame:
    """The partial counts of all portions together."""
    together = reduce(DataFrame.unionByName, portions)
    return together.groupBy(*groups, "v").agg(F.sum("w").alias("w"))


@settled
def bisect_percentiles(counts: DataFrame, groups: Sequence[str], percents: Sequence[int], fanout: int = 16) -> DataFrame:
    """Exact percentiles of weighted values: the group columns, ``percent``, ``value``, ``weight`` (total).

    ``counts`` has the group columns, ``v`` and a positive whole ``w``. Null group values form a group of
    their own. Percentiles are whole numbers from 0 to 100; 0 gives the minimum.
    """
    if not percents or any(p != int(p) or not 0 <= p <= 100 for p in percents):
        raise ValueError("percents must be whole numbers from 0 to 100")
    if taken := {"percent", "value", "weight"} & set(groups):
        raise ValueError(f"group columns may not be named {sorted(taken)}")
    # own names inside, so that no group column clashes with a working column
    given, groups = list(groups), [f"_group{k}" for k in range(len(groups))]
    counts = stage_table(counts.select(*[F.col(g).alias(n) for g, n in zip(given, groups, strict=True)], "v", "w"))
    state = (
        counts.groupBy(*groups)
        .agg(F.sum("w").alias("total"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        .withColumn("percent", F.explode(F.array(*[F.lit(int(p)) for p in percents])))
        .withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("total").cast("decimal(22,0)") * F.col("percent") / 100)).cast("long"))
        .withColumn("below", F.lit(0).cast("long"))
        .select(*groups, "percent", "total", "rank", "below", "lo", "hi")
    )
    state = stage_table(state)
    finished = []
    while True:
        finished.append(state.where("lo = hi").select(*[F.col(n).alias(g) for g, n in zip(given, groups, strict=True)], "percent", F.col("lo").alias("value"), F.col("total").alias("weight")))
        active = state.where("lo <> hi")
        if not active.take(1):
            break
        names = [f"_g{k}" for k in range(len(groups))]
        named = active.select(*[F.col(g).alias(n) for g, n in zip(groups, names, strict=True)], "percent", "total", "rank", "below", "lo", "hi")
        match = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(n)) for g, n in zip(groups, names, strict=True)], F.lit(True))
        rows = counts.join(named, match & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))

        def part(scale) -> Column:
            a, b, x = (scale(F.col(c).cast("double")) for c in ("lo", "hi", "v"))
            return F.when(b > a, F.least(F.lit(fanout - 1), F.floor((x - a) / (b - a) * fanout)))

        index = (
            F.when(F.col("v") == F.col("lo"), 0)
            .when(F.col("v") == F.col("hi"), fanout - 1)
            .otherwise(F.coalesce(part(_by_magnitude), part(lambda c: c), F.lit(fanout // 2)))
        )
        parts = (
            rows.withColumn("part", index.cast("int"))
            .groupBy(*names, "percent", "total", "rank", "below", "part")
            .agg(F.sum("w").alias("w"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        )
        # at most `fanout` rows for each group and percentile
        along = Window.partitionBy(*names, "percent").orderBy("part")
        upto = parts.withColumn("upto", F.sum("w").over(along) + F.col("below"))
        chosen = upto.where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("w") < F.col("rank")))
        following = stage_table(
            chosen.select(
                *[F.col(n).alias(g) for g, n in zip(groups, names, strict=True)],
                "percent",
                "total",
                "rank",
                (F.col("upto") - F.col("w")).alias("below"),
                "lo",
                "hi",
            )
        )
        state = following
    return reduce(DataFrame.unionByName, finished)


def percentiles(df: DataFrame, groups: Sequence[str], value: str, percents: Sequence[int], weight: str | None = None) -> DataFrame:
    """Exact percentiles of ``value`` per group; see :func:`bisect_percentiles` for the result.

    Defined cases: null and NaN values do not count, groups without any value give no row, repeated rows
    count as often as they occur (drop them before if they must not), an empty input gives no rows.
    """
    inner = [f"_given{k}" for k in range(len(groups))]
    kept = df.select(*[F.col(g).alias(n) for g, n in zip(groups, inner, strict=True)], F.col(value).alias("_value"), *([F.col(weight).alias("_weight")] if weight else []))
    found = bisect_percentiles(partial_counts(kept, inner, "_value", "_weight" if weight else None, bits=None), inner, percents)
    return found.withColumnsRenamed(dict(zip(inner, groups, strict=True)))


__all__ = ["BITS", "ERROR_BOUND", "bisect_percentiles", "merge_partials", "partial_counts", "percentiles"]
