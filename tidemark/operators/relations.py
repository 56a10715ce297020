"""Derived relations that analyses read instead of the raw changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import stage_table
from tidemark.sources.facts import FactStore

LINEAGE_DEPTH = 50


def bucketed(fs: FactStore) -> DataFrame:
    """Changes with all revisions of a day, week or month as one; ``rev`` is the period's first day."""
    at = F.date_format(F.date_trunc(fs.options.time_bucket or "day", "date"), "yyyy-MM-dd").alias("rev")
    return fs.dated_changes.groupBy(at, "path").agg(
        F.sum("loc_added").alias("loc_added"),
        F.sum("loc_deleted").alias("loc_deleted"),
        F.max_by("change_type", F.struct("date", -F.col("seq"))).alias("change_type"),
    )


def _later(date: str, seq: str) -> Column:
    """Order of commits in time as one comparable value: of one second, the smaller ``seq`` is later."""
    return F.struct(F.unix_micros(date).alias("t"), (-F.col(seq)).alias("s"))


def lineage_epochs(fs: FactStore) -> DataFrame:
    """Retirements of names: ``path``, ``since`` and ``until`` (exclusive), ``canonical``.

    A name that was renamed away n times has n epochs; within one, changes belong to the name it finally
    became. Renames are followed forward in time; copies retire nothing; at most 50 steps are followed.
    """
    renames = fs.dated_changes.where("change_type = 'renamed' and rename_from is not null and rename_from <> '' and rename_from <> path").select(
        F.col("rename_from").alias("src"), F.col("path").alias("dst"), _later("date", "seq").alias("at")
    )
    # one step out of a name: its first retirement after a moment
    steps = stage_table(renames.groupBy("src", "at").agg(F.min("dst").alias("dst")))
    by_name = Window.partitionBy("src").orderBy("at")
    epochs = steps.select("src", "at", "dst", F.lag("at").over(by_name).alias("since"))
    current = epochs.select(F.col("src").alias("path"), "since", F.col("at").alias("until"), F.col("dst").alias("canonical"), F.col("at").alias("reached"), F.lit(False).alias("done"))
    current = stage_table(current)
    for _ in range(LINEAGE_DEPTH):
        following = (
            current.where("not done")
            .alias("c")
            .join(steps.alias("s"), (F.col("c.canonical") == F.col("s.src")) & (F.col("s.at") > F.col("c.reached")), "left")
            .groupBy("c.path", "c.since", "c.until", "c.canonical", "c.reached")
            .agg(F.min_by("s.dst", "s.at").alias("next"), F.min("s.at").alias("next_at"))
            .select("path", "since", "until", F.coalesce("next", "canonical").alias("canonical"), F.coalesce("next_at", "reached").alias("reached"), F.col("next").isNull().alias("done"))
        )
        current = stage_table(current.where("done").unionByName(following))
        if not current.where("not done").take(1):
            break
    return current.select("path", "since", "until", "canonical")


def lineage_changes(fs: FactStore) -> DataFrame:
    """Changes under the name their file finally got; several of one revision on one name are added up."""
    epochs = lineage_epochs(fs).where("path <> canonical")
    d = fs.dated_changes.withColumn("at", _later("date", "seq")).alias("d")
    e = epochs.alias("e")
    inside = (F.col("d.path") == F.col("e.path")) & (F.col("d.at") < F.col("e.until")) & (F.col("e.since").isNull() | (F.col("d.at") >= F.col("e.since")))
    mapped = d.join(e, inside, "left").select(
        "d.rev", F.coalesce("e.canonical", "d.path").alias("path"), "d.change_type", "d.loc_added", "d.loc_deleted", "d.date", "d.seq"
    )
    return mapped.groupBy("rev", "path").agg(
        F.sum("loc_added").alias("loc_added"), F.sum("loc_deleted").alias("loc_deleted"), F.max("change_type").alias("change_type"), F.max("date").alias("date"), F.max("seq").alias("seq")
    )


def lineage_revisions(fs: FactStore) -> DataFrame:
    """Revisions per file under its final name."""
    counted = lineage_changes(fs).groupBy("path").agg(F.count(F.lit(1)).alias("n_revs"))
    return counted.where(F.col("n_revs") >= fs.options.min_revs)


def bucketed_changes(fs: FactStore) -> DataFrame:
    """The time-bucketed changes themselves."""
    return bucketed(fs)


def group_of(rules: list[tuple[str, str]], path: str = "path") -> Column:
    """The group of a path by ordered rules ``(pattern, name)``; the first match wins, null if none does.

    A pattern that starts with ``^`` is a regular expression; any other is a prefix of whole folders.
    """
    chosen = F.lit(None).cast("string")
    for pattern, name in reversed(rules):
        plain = pattern.rstrip("/")
        hit = F.col(path).rlike(pattern) if pattern.startswith("^") else (F.col(path) == plain) | F.col(path).startswith(plain + "/")
        chosen = F.when(hit, F.lit(name)).otherwise(chosen)
    return chosen


def grouped_changes(fs: FactStore, rules: list[tuple[str, str]], strict: bool = False) -> DataFrame:
    """Changes by architectural group; unmapped paths keep their name or, if strict, are dropped."""
    target = group_of(rules)
    named = fs.changes.withColumn("group", target if strict else F.coalesce(target, F.col("path"))).where("group is not null")
    return named.groupBy("rev", F.col("group").alias("path")).agg(
        F.sum("loc_added").alias("loc_added"), F.sum("loc_deleted").alias("loc_deleted"), F.max("change_type").alias("change_type"), F.max_by("rename_from", "path").alias("rename_from")
    )


GROUP_RULES = [("apps", "applications"), ("^(libs|packages)/", "libraries"), ("^tools/[a-m]", "tools a-m")]


def grouped(fs: FactStore) -> DataFrame:
    """Changes grouped by the example rules."""
    return grouped_changes(fs, GROUP_RULES, strict=True).drop("rename_from")


def sampled_commits(fs: FactStore, samples: int = 12) -> DataFrame:
    """Evenly spaced commits in time: ``rev``, ``date``, ``k``.

    Places are taken from counts per day, so that only the days are put in order, never all commits.
    """
    days = fs.commits.groupBy(F.to_date("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    before = days.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("day").orderBy("date", F.desc("seq"))
    placed = fs.commits.select("rev", "date", "seq", F.to_date("date").alias("day")).withColumn("in_day", F.row_number().over(inside)).join(before, "day")
    total = days.agg(F.sum("n").alias("total"))
    place = F.col("before") + F.col("in_day") - 1
    wanted = F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))
    targets = total.withColumn("k", wanted).select("k", F.floor(F.col("k") * (F.col("total") - 1) / (samples - 1)).cast("long").alias("place")).groupBy("place").agg(F.min("k").alias("k"))
    return placed.withColumn("place", place.cast("long")).join(F.broadcast(targets), "place").select("rev", "date", "seq", F.col("k").cast("long").alias("k"))


def sampled(fs: FactStore) -> DataFrame:
    """The sampled commits with their day."""
    return sampled_commits(fs).select("k", "rev", F.date_format("date", "yyyy-MM-dd").alias("date"))
