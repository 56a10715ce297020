"""Statistics as column expressions, and as vectorised functions where columns cannot express them."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

Z_95 = 1.96
_TIE = 1e-9


def log_factorials(n: int) -> np.ndarray:
    """ln 0!, ln 1!, ..., ln n!."""
    return np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, n + 1, dtype=float)))))


def fisher_two_tailed(a: int, b: int, c: int, d: int, table: np.ndarray | None = None) -> float | None:
    """Exact two-tailed p of the table ((a, b), (c, d)); ``None`` if a margin is 0 or a cell negative."""
    if min(a, b, c, d) < 0:
        return None
    row, rest, col, other = a + b, c + d, a + c, b + d
    n = row + rest
    if not row or not rest or not col or not other:
        return None
    lf = table if table is not None and len(table) > n else log_factorials(n)
    low, high = max(0, col - rest), min(row, col)
    k = np.arange(low, high + 1)
    fixed = lf[row] + lf[rest] + lf[col] + lf[other] - lf[n]
    logs = fixed - lf[k] - lf[row - k] - lf[col - k] - lf[rest - col + k]
    return float(min(1.0, np.exp(logs[logs <= logs[a - low] + _TIE]).sum()))


_TABLES: dict[int, np.ndarray] = {}


@F.pandas_udf(T.DoubleType())
def fisher_p(shared: pd.Series, revs_a: pd.Series, revs_b: pd.Series, n: pd.Series) -> pd.Series:
    """Two-tailed p that two sets of revisions overlap as they do, of ``n`` revisions."""
    top = int(n.max()) if len(n) else 0
    size = 1 << max(4, top.bit_length())
    if size not in _TABLES:
        _TABLES[size] = log_factorials(size)
    known: dict = {}
    out = []
    for key in zip(shared, revs_a, revs_b, n, strict=True):
        if key not in known:
            s, ra, rb, total = map(int, key)
            known[key] = fisher_two_tailed(s, ra - s, rb - s, total - (ra + rb - s), _TABLES[size])
        out.append(known[key])
    return pd.Series(out, dtype="float64")


def magnitude_bucket(value: Column) -> Column:
    """A whole number that never falls while the value grows: 256 steps for each doubling, on either side of 0."""
    size = F.abs(value.cast("double"))
    return F.when(size == 0, 0).otherwise(F.signum(value.cast("double")) * (F.floor((F.log2(size) + 1100) * 256) + 1)).cast("long")


def count_below(counts: DataFrame, value: str, n: str, by: Sequence[str] = ()) -> DataFrame:
    """``counts`` (one row for each value, weighted ``n``) with ``_less``, the weight of smaller values, and ``_total``.

    Values are put in order within buckets of nearly equal magnitude, and only the buckets, of which there are
    some thousand at most whatever the number of values, in one row of their own. No task sorts all values.
    """
    placed = counts.withColumn("_bucket", magnitude_bucket(F.col(value)))
    sums = placed.groupBy(*by, "_bucket").agg(F.sum(n).alias("_in"))
    whole = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_in").over(whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(*by, "_bucket", before.alias("_before"), F.sum("_in").over(whole).alias("_total"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("_inside", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    return ranked.join(offsets, [*by, "_bucket"]).withColumn("_less", F.col("_before") + F.col("_inside")).drop("_bucket", "_before", "_inside")


def benjamini_hochberg(df: DataFrame, p: str, alpha: float) -> DataFrame:
    """The rows whose p is at most the largest p(k) <= k/m * alpha. Null p counts as not significant.

    Equal p values are counted together first, and ranked by :func:`count_below`.
    """
    counts = df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_m"))
    # candidates only: a p above alpha is never at or below its threshold
    ranked = count_below(counts.where(F.col("_p") <= alpha), "_p", "_n").withColumn("_k", F.col("_less") + F.col("_n"))
    cut = ranked.join(F.broadcast(total)).where(F.col("_p") <= F.col("_k") / F.col("_m") * alpha).agg(F.max("_p").alias("_cut"))
    return df.join(F.broadcast(cut), F.col(p) <= F.col("_cut")).drop("_cut")


def wilson_interval(hits: Column, n: Column, z: float = Z_95) -> tuple[Column, Column]:
    """Lower and upper bound of a share, between 0 and 1; null for no observation."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    share = hits.cast("double") / n
    scale = 1 + z * z / n
    middle = (share + z * z / (2 * n)) / scale
    half = z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n)) / scale
    return F.greatest(F.lit(0.0), middle - half), F.least(F.lit(1.0), middle + half)


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the curve by mid-ranks; null unless both labels occur. One row, ``auc``.

    Scores are counted per distinct value before they are ranked.
    """
    per = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label)).alias("pos"), F.count_if(~F.col(label)).alias("neg"))
    below = count_below(per, "s", "neg")
    wins = F.sum(F.col("pos") * (F.col("_less") + F.col("neg") / 2.0))
    return below.agg((wins / F.nullif(F.sum("pos").cast("double") * F.sum("neg"), F.lit(0.0))).alias("auc"))


def precision_at(df: DataFrame, score: str, label: str, tie: str, k: int) -> DataFrame:
    """Share of positives among the ``k`` highest scores, equal scores by ``tie``. One row, ``precision``."""
    return df.orderBy(F.desc(score), tie).limit(k).agg(F.avg(F.col(label).cast("double")).alias("precision"))


def control_chart(values: Sequence[float]) -> dict[str, object]:
    """Mean, mean moving range and attention of a short series, last value newest.

    Attention: the last value is more than 2.66 mean moving ranges off the mean, or the last eight values
    are on one side of it. Fewer than four values never call for attention.
    """
    if len(values) < 4:
        return {"mean": None, "moving_range": None, "attention": False}
    mean = math.fsum(values) / len(values)
    moving = math.fsum(abs(b - a) for a, b in zip(values, values[1:], strict=False)) / (len(values) - 1)
    side = {(v > mean) - (v < mean) for v in values[-8:]}
    run = len(values) >= 8 and len(side) == 1 and 0 not in side
    return {"mean": mean, "moving_range": moving, "attention": abs(values[-1] - mean) > 2.66 * moving or run}
