"""One ranking from several scores on different scales, by distance to an ideal point.

Each score is winsorised at exact percentiles, divided by its vector length, and weighted. The ideal
point has the greatest value of every score, the anti-ideal the least; items go by relative closeness
``d_anti / (d_ideal + d_anti)``. A score with larger numbers does not prevail, as every score has length
one; extreme values do not stretch the scale, as they were winsorised.

Places are counted without gathering the items: a global sort is stored, rows are numbered inside their
partition, and the sizes of the partitions before it are added.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.quantiles import percentiles
from tidemark.operators.places import place_rows
from tidemark.session import settled, stage_table

_SCALE = 10**6
_LARGEST = 9e12  # beyond it scores are equal: six decimals of it still fit a long


@settled
def ideal_point_ranking(
    df: DataFrame, key: str, weights: Mapping[str, float], winsor: tuple[int, int] = (1, 99)
) -> DataFrame:
    """Rank the distinct keys by several scores, greatest first; equal closeness goes by key ascending.

    Result: ``key``, ``place``, ``closeness``. ``weights`` names the score columns; a greater score means a
    higher rank. Scores are taken to six decimals and up to 9e12 in size, larger ones as that.

    Defined cases: a null key gets no place; of repeated keys the row with the greatest scores, compared in
    the order of ``weights``, counts; a null, NaN or infinite score takes the median of its column, so that
    it speaks neither for nor against an item; a column without any value, or with one value only, adds
    nothing; an empty input gives no rows.
    """
    fields = list(weights)
    if not fields or any(w <= 0 for w in weights.values()):
        raise ValueError("weights must name at least one score, each with a positive weight")

    def clean(name: str) -> Column:
        value = F.col(name).cast("double")
        finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
        return F.when(finite, F.rint(F.greatest(F.lit(-_LARGEST), F.least(F.lit(_LARGEST), value)) * _SCALE).cast("long")).alias(name)

    items = (
        df.select(F.col(key).alias("key"), *[clean(f) for f in fields])
        .where("key is not null")
        .groupBy("key")
        .agg(F.max(F.struct(*fields)).alias("s"))
        .select("key", *[F.col("s")[f].alias(f) for f in fields])
    )
    items = stage_table(items)
    unpivoted = items.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("r")).select("r.field", "r.value")
    low, high = winsor
    # three numbers for each score
    known = {(r["field"], r["percent"]): r["value"] for r in percentiles(unpivoted, ["field"], "value", sorted({low, 50, high})).collect()}
    live = [f for f in fields if (f, low) in known]
    capped = items.select(
        "key",
        *[
            F.greatest(F.lit(known[f, low]), F.least(F.lit(known[f, high]), F.coalesce(F.col(f), F.lit(known[f, 50])))).alias(f)
            for f in live
        ],
    )
    # sums of whole numbers do not depend on the order of adding; very large ones may leave the whole numbers
    def square(f: str) -> Column:
        if max(abs(known[f, low]), abs(known[f, high])) < 10**15:
            return (F.col(f).cast("decimal(19,0)") * F.col(f).cast("decimal(19,0)")).cast("decimal(38,0)")
        return F.col(f).cast("double") * F.col(f).cast("double")

    if live:
        sums = capped.agg(*[F.sum(square(f)).alias(f) for f in live]).first()
    toward, away = F.lit(0.0), F.lit(0.0)
    for f in live:
        length = float(sums[f] or 0) ** 0.5
        if not length or known[f, low] == known[f, high]:
            continue
        scale = weights[f] / length
        below = (F.lit(known[f, high]) - F.col(f)).cast("double") * F.lit(scale)
        above = (F.col(f) - F.lit(known[f, low])).cast("double") * F.lit(scale)
        toward, away = toward + below * below, away + above * above
    near, far = F.sqrt(toward), F.sqrt(away)
    closeness = F.when(near + far > 0, far / (near + far)).otherwise(F.lit(0.0))
    # twelve decimals are far above the rounding of the sums and keep equal items equal
    scored = capped.select("key", F.round(closeness, 12).alias("closeness"))
    return place_rows(scored, F.desc("closeness"), F.asc("key")).select("key", "place", "closeness")
