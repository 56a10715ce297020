"""Items that appear together in baskets, with lift and pointwise mutual information.

Method: items are deduplicated per basket, ordered pairs are emitted, counts are combined map-side and
lift comes from the marginals. The table is read twice: once for the rows of every basket and item, once
for the postings (the baskets of each item), which are stored and serve everything after.

* Postings of items with many rows are dealt to salts by basket, so that no task and no row holds a hot
  item. At most ``_LARGE`` items have that many rows; they are broadcast.
* An item in fewer than ``min_support`` baskets is in no frequent pair. Since n(a,b) <= min(n(a), n(b)),
  lift n(a,b)*N/(n(a)*n(b)) is at most N/max(n(a), n(b)), so an item in more than N/min_lift baskets is in
  no pair that stands out. Both kinds leave before the postings are turned into baskets.
* The ``min_support - 1`` largest baskets are set aside. A pair in ``min_support`` baskets is in at least
  one other basket, so emitting pairs from the others finds all candidates; each item carries a bit mask
  of the set-aside baskets it is in, and two masks give the missing part of the count.
* Baskets above ``block_rows`` rows are split into blocks, and pairs are made per pair of blocks, so that
  no task holds a large basket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import settled, stage_table

_MAX_SET_ASIDE = 7
_LARGE = 200_000


def _fingerprint(column: Column, one: str, two: str) -> list[Column]:
    """A value as two longs: 128 bits identify it in any shuffle instead of its text."""
    text = column.cast("string")
    return [F.xxhash64(text).alias(one), F.xxhash64(F.lit("basket"), text).alias(two)]


def _pairs_within(blocks: DataFrame) -> DataFrame:
    """Ordered pairs of the members of each array."""
    return (
        blocks.where(F.size("keys") > 1)
        .select(F.sort_array("keys").alias("keys"))
        .select("keys", F.posexplode("keys").alias("pos", "ka"))
        .select("ka", F.explode(F.slice("keys", F.col("pos") + 2, F.size("keys"))).alias("kb"))
    )


@settled
def cooccurrence(
    baskets: DataFrame,
    basket: str,
    item: str,
    min_support: int = 8,
    min_lift: int = 5,
    block_rows: int = 512,
    posting_rows: int = 200_000,
) -> DataFrame:
    """Pairs of items that share at least ``min_support`` baskets with a lift of at least ``min_lift``.

    Result: ``item_a`` < ``item_b`` (by UTF-8 bytes), ``n_a``, ``n_b``, ``n_ab``, ``n`` (baskets),
    ``lift``, ``pmi`` (natural logarithm).

    Defined cases: rows with a null basket or item do not count; repeated rows count once; the empty
    string is an item like any other; ties do not matter, as no pair is cut off; an empty input gives no
    rows. Columns other than the two are ignored.
    """
    if min_support < 1 or min_lift < 1 or block_rows < 2:
        raise ValueError("min_support and min_lift must be at least 1, block_rows at least 2")
    rows = baskets.select(*_fingerprint(F.col(basket), "b1", "b2"), F.col(item).cast("string").alias("item")).where(
        F.col(basket).isNotNull() & F.col(item).isNotNull()
    )
    # rows of each basket and each item in one pass
    sides = F.array(
        F.struct(F.lit(True).alias("is_basket"), F.col("b1").alias("k1"), F.col("b2").alias("k2")),
        F.struct(F.lit(False).alias("is_basket"), *_fingerprint(F.col("item"), "k1", "k2")),
    )
    tally = stage_table(rows.select(F.explode(sides).alias("s")).groupBy("s.is_basket", "s.k1", "s.k2").agg(F.count(F.lit(1)).alias("rows")))
    sizes = tally.where("is_basket").select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), "rows")
    known = sizes.agg(F.count(F.lit(1)).alias("baskets"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
    total = known["baskets"]
    if not total:
        empty = "item_a string, item_b string, n_a long, n_b long, n_ab long, n long, lift double, pmi double"
        return baskets.sparkSession.createDataFrame([], empty)
    aside = [
        (r["b1"], r["b2"])
        for r in sizes.where(F.col("rows") > 1).orderBy(F.desc("rows"), "b1", "b2").limit(min(min_support - 1, _MAX_SET_ASIDE)).collect()
    ]
    bits = len(aside)

    def flag_of(b1: Column, b2: Column) -> Column:
        flag = F.lit(0)
        for k, (one, two) in enumerate(aside):
            flag = F.when((b1 == one) & (b2 == two), 1 << k).otherwise(flag)
        return flag.cast("long")

    # rows add up to `known["rows"]`, so at most _LARGE items have more than its _LARGE-th part
    share = max(posting_rows, known["rows"] // _LARGE)
    large = F.broadcast(tally.where(~F.col("is_basket") & (F.col("rows") > share)).select(F.col("k1").alias("i1"), F.col("k2").alias("i2"), F.ceil(F.col("rows") / share).alias("salts")))
    dealt = (
        rows.select("b1", "b2", "item", *_fingerprint(F.col("item"), "i1", "i2"))
        .join(large, ["i1", "i2"], "left")
        .select("b1", "b2", "item", F.col("salts").isNotNull().alias("dealt"), F.coalesce(F.pmod("b1", "salts"), F.lit(0)).alias("salt"))
    )
    gathered = dealt.groupBy("item", "dealt", "salt").agg(F.collect_set(F.struct("b1", "b2")).alias("posting"))
    # ids are fixed by writing them
    postings = stage_table(
        gathered.select("item", "dealt", "posting", F.size("posting").cast("long").alias("n"), F.aggregate("posting", F.lit(0).cast("long"), lambda m, b: m.bitwiseOR(flag_of(b["b1"], b["b2"]))).alias("mask"))
        .where(F.col("dealt") | ((F.col("n") >= min_support) & (F.col("n") * min_lift <= total)))
        .withColumn("id", F.monotonically_increasing_id())
    )
    coded = (F.col("id") * (1 << _MAX_SET_ASIDE) + F.col("mask")).alias("key")
    small = postings.where("not dealt")
    # an item that was dealt counts as a whole (at most _LARGE of them)
    whole = (
        postings.where("dealt").groupBy("item").agg(F.sum("n").alias("n"), F.bit_or("mask").alias("mask"), F.min("id").alias("id")).where((F.col("n") >= min_support) & (F.col("n") * min_lift <= total))
    )
    stats = small.select("item", "n", coded).unionByName(whole.select("item", "n", coded))
    placed = small.select(coded, "posting").unionByName(postings.where("dealt").select("item", "posting").join(F.broadcast(whole), "item").select(coded, "posting"))
    at = F.col("b")
    kept = placed.select("key", F.explode("posting").alias("b")).where(flag_of(at["b1"], at["b2"]) == 0).select("b.b1", "b.b2", "key")

    wide = sizes.where(F.col("rows") > block_rows).select(
        "b1", "b2", F.ceil(F.col("rows") / block_rows).cast("int").alias("blocks")
    )
    members = (
        kept.join(wide, ["b1", "b2"], "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
        .groupBy("b1", "b2", "blocks", "block")
        .agg(F.collect_set("key").alias("keys"))
    )
    large = members.where("blocks > 1")
    left = large.select("b1", "b2", F.col("keys").alias("keys_a"), "block", F.explode(F.sequence(F.col("block") + 1, F.col("blocks"))).alias("other")).where(
        "other < blocks"
    )
    right = large.select("b1", "b2", F.col("keys").alias("keys_b"), F.col("block").alias("other"))
    across = (
        left.join(right, ["b1", "b2", "other"])
        .select(F.explode("keys_a").alias("ka"), "keys_b")
        .select("ka", F.explode("keys_b").alias("kb"))
        .select(F.least("ka", "kb").alias("ka"), F.greatest("ka", "kb").alias("kb"))
    )
    pairs = _pairs_within(members).unionByName(across).groupBy("ka", "kb").agg(F.count(F.lit(1)).alias("seen"))
    shared = F.col("seen") + F.bit_count(F.col("ka").bitwiseAND(F.col("kb")).bitwiseAND(F.lit((1 << bits) - 1)))
    frequent = pairs.select("ka", "kb", shared.cast("long").alias("n_ab")).where(F.col("n_ab") >= min_support)

    def side(name: str) -> DataFrame:
        return stats.select(F.col("key").alias(f"k{name}"), F.col("item").alias(f"item_{name}"), F.col("n").alias(f"n_{name}"))

    wide_number = "decimal(38,0)"
    joined = (
        frequent.join(side("a"), "ka")
        .join(side("b"), "kb")
        .where(
            F.col("n_ab").cast("decimal(19,0)") * F.lit(total).cast("decimal(19,0)")
            >= (F.col("n_a").cast("decimal(19,0)") * F.col("n_b").cast("decimal(19,0)")).cast(wide_number) * F.lit(min_lift).cast("decimal(9,0)")
        )
    )
    ordered = F.col("item_a") < F.col("item_b")
    lift = F.col("n_ab").cast("double") * F.lit(float(total)) / (F.col("n_a").cast("double") * F.col("n_b").cast("double"))
    return joined.select(
        F.when(ordered, F.col("item_a")).otherwise(F.col("item_b")).alias("item_a"),
        F.when(ordered, F.col("item_b")).otherwise(F.col("item_a")).alias("item_b"),
        F.when(ordered, F.col("n_a")).otherwise(F.col("n_b")).alias("n_a"),
        F.when(ordered, F.col("n_b")).otherwise(F.col("n_a")).alias("n_b"),
        "n_ab",
        F.lit(total).cast("long").alias("n"),
        lift.alias("lift"),
        F.log(lift).alias("pmi"),
    )
