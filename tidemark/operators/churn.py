"""Counting, churn and age analyses. Each takes a fact store and returns one DataFrame.

Common cases: null paths and revisions do not count, repeated rows count once, null or negative line
counts are 0, empty tables give no rows. Ordering belongs to the output boundary, not to an analysis.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.facts import FactStore, live_at


def _day(moment: str) -> Column:
    return F.date_format(moment, "yyyy-MM-dd")


def summary(fs: FactStore) -> DataFrame:
    """``metric``, ``value``: commits, changes, entities and human authors."""
    one = lambda name, df, value: df.agg(value.cast("long").alias("value")).select(F.lit(name).alias("metric"), "value")
    commits = one("commits", fs.commits, F.count(F.lit(1)))
    entities = one("entities", fs.changes, F.count_distinct("path"))
    changes = one("changes", fs.changes, F.count(F.lit(1)))
    people = fs.commits if fs.options.compat else fs.human_commits
    authors = one("authors", people, F.count_distinct("canonical_author"))
    return commits.unionByName(entities).unionByName(changes).unionByName(authors)


def revisions(fs: FactStore, changes: DataFrame | None = None) -> DataFrame:
    """``path``, ``n_revs`` of paths with at least ``min_revs`` revisions."""
    source = fs.changes if changes is None else changes
    return source.groupBy("path").agg(F.count(F.lit(1)).alias("n_revs")).where(F.col("n_revs") >= fs.options.min_revs)


def authors(fs: FactStore) -> DataFrame:
    """Authors per path: all, human, machine, revisions, and who came last.

    An author is a machine for a path if no raw identity of theirs is a known human's, or if all their
    commits there were written by a machine.
    """
    humans = fs.human_commits.select("canonical_author").distinct().withColumn("human", F.lit(True))
    ai = F.coalesce(F.col("ai_attribution") == "ai-authored", F.lit(False))
    per = (
        fs.dated_changes.groupBy("path", "canonical_author")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(ai.cast("int")).alias("by_ai"), F.max("date").alias("last_at"))
        .join(humans, "canonical_author", "left")
    )
    bot = F.col("human").isNull() | (F.col("by_ai") == F.col("n"))
    return per.groupBy(F.col("path").alias("entity")).agg(
        F.count(F.lit(1)).alias("n_authors"),
        F.sum((~bot).cast("long")).alias("n_humans"),
        F.sum(bot.cast("long")).alias("n_bots"),
        F.sum("n").alias("n_revs"),
        F.min_by("canonical_author", F.struct((-F.unix_micros("last_at")).alias("k"), "canonical_author")).alias("last_author"),
        _day(F.max("last_at")).alias("last_modified"),
    )


def top_committers(fs: FactStore) -> DataFrame:
    """Commits and lines of every author, with first and last day; commits without changes count."""
    lines = fs.raw_changes.groupBy("rev").agg(F.sum("loc_added").alias("added"), F.sum("loc_deleted").alias("deleted"))
    humans = fs.human_commits.select("canonical_author").distinct().withColumn("human", F.lit(True))
    return (
        fs.commits.select("rev", "canonical_author", "date")
        .join(lines, "rev", "left")
        .groupBy(F.col("canonical_author").alias("author"))
        .agg(
            F.count(F.lit(1)).alias("commits"),
            F.coalesce(F.sum("added"), F.lit(0)).alias("loc_added"),
            F.coalesce(F.sum("deleted"), F.lit(0)).alias("loc_deleted"),
            _day(F.min("date")).alias("first_commit"),
            _day(F.max("date")).alias("last_commit"),
        )
        .join(humans.withColumnRenamed("canonical_author", "author"), "author", "left")
        .select("author", "commits", "loc_added", "loc_deleted", "first_commit", "last_commit", F.col("human").isNull().alias("is_bot"))
    )


def _per_commit(fs: FactStore) -> DataFrame:
    lines = fs.changes.groupBy("rev").agg(F.sum("loc_added").alias("added"), F.sum("loc_deleted").alias("deleted"))
    return lines.join(fs.commits.select("rev", "date", "canonical_author"), "rev")


def abs_churn(fs: FactStore) -> DataFrame:
    """Lines and commits per calendar day."""
    return (
        _per_commit(fs).groupBy(_day("date").alias("date")).agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.count(F.lit(1)).alias("commits"))
    )


def author_churn(fs: FactStore) -> DataFrame:
    """Lines and commits per author."""
    return (
        _per_commit(fs)
        .groupBy(F.col("canonical_author").alias("author"))
        .agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.count(F.lit(1)).alias("commits"))
    )


def entity_churn(fs: FactStore) -> DataFrame:
    """Lines and commits per live path with at least ``min_revs`` revisions; one aggregate finds both."""
    return (
        fs.dated_changes.groupBy("path")
        .agg(
            F.sum("loc_added").alias("added"),
            F.sum("loc_deleted").alias("deleted"),
            F.count(F.lit(1)).alias("commits"),
            F.max_by("change_type", F.struct("date", -F.col("seq"))).alias("latest"),
        )
        .where((F.col("commits") >= fs.options.min_revs) & (F.col("latest") != "deleted"))
        .drop("latest")
    )


def _months(later: Column, earlier: Column) -> Column:
    months = (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)
    return (months - (F.dayofmonth(later) < F.dayofmonth(earlier)).cast("int")).cast("long")


def code_age(fs: FactStore) -> DataFrame:
    """Months and days since the last change of each path alive at the anchor day's end."""
    anchor = F.date_trunc("day", fs.anchor) + F.expr("INTERVAL 86399 SECONDS")
    last = (
        fs.dated_changes.where(F.col("date") <= anchor)
        .groupBy("path")
        .agg(F.max("date").alias("last"), F.max_by("change_type", F.struct("date", -F.col("seq"))).alias("latest"))
        .where("latest <> 'deleted'")
    )
    return last.select(
        "path", _months(anchor, F.col("last")).alias("age_months"), F.datediff(anchor, "last").cast("long").alias("age_days"), _day("last").alias("last_modified")
    )


def stale_code(fs: FactStore) -> DataFrame:
    """Live, simple paths untouched for a year: at least 12 months, branch count at most 5."""
    last = fs.dated_changes.groupBy("path").agg(F.max("date").alias("last"), F.max_by("change_type", F.struct("date", -F.col("seq"))).alias("latest")).where("latest <> 'deleted'")
    peak = fs.files.select("path", "cognitive")
    return (
        last.join(peak, "path", "left")
        .select("path", _day("last").alias("last_touched"), _months(fs.anchor, F.col("last")).alias("months_since_touched"), F.coalesce("cognitive", F.lit(0)).alias("max_cognitive"))
        .where("months_since_touched >= 12 and max_cognitive <= 5")
    )


def messages(fs: FactStore) -> DataFrame:
    """How many commits with a matching message touched each path."""
    if not fs.options.expression:
        raise ValueError("messages needs an expression")
    hits = fs.commits.where(F.col("message").rlike(fs.options.expression)).select("rev")
    return fs.changes.join(hits, "rev", "left_semi").groupBy(F.col("path").alias("entity")).agg(F.count(F.lit(1)).alias("matches"))


def good_commits(fs: FactStore, changes: DataFrame | None = None) -> DataFrame:
    """Revisions that touch at most ``max_changeset_size`` paths, with the number of paths."""
    source = fs.changes if changes is None else changes
    return source.groupBy("rev").agg(F.count(F.lit(1)).alias("n_files")).where(F.col("n_files") <= fs.options.max_changeset_size)


def soc(fs: FactStore) -> DataFrame:
    """Sum of coupling: how many other paths changed along with each path, over moderate commits."""
    total = fs.changes.join(good_commits(fs), "rev").groupBy(F.col("path").alias("entity")).agg(F.sum(F.col("n_files") - 1).alias("soc"))
    return total.where(F.col("soc") > fs.options.min_revs if fs.options.compat else F.col("soc") >= fs.options.min_soc)


def hotspot_velocity(fs: FactStore) -> DataFrame:
    """Revisions per week in the last 30 days against the 90 days before, in one pass."""
    recent_from, base_from = fs.anchor - F.expr("INTERVAL 30 DAYS"), fs.anchor - F.expr("INTERVAL 120 DAYS")
    seen = fs.dated_changes.where((F.col("date") > base_from) & (F.col("date") <= fs.anchor))
    counted = seen.groupBy("path").agg(
        F.count_if(F.col("date") > recent_from).alias("revs_recent"), F.count_if(F.col("date") <= recent_from).alias("revs_baseline")
    )
    recent, base = F.col("revs_recent") * 7 / 30.0, F.col("revs_baseline") * 7 / 90.0
    return counted.where((F.col("revs_recent") >= 1) & (F.col("revs_recent") + F.col("revs_baseline") >= fs.options.min_revs)).select(
        "path", "revs_recent", "revs_baseline", recent.cast("double").alias("recent_per_week"), base.cast("double").alias("baseline_per_week"), (recent - base).cast("double").alias("acceleration")
    )


def live_paths(fs: FactStore) -> DataFrame:
    """Paths whose latest change is no deletion."""
    return fs.live_paths


def live_paths_at(fs: FactStore) -> DataFrame:
    """Paths alive at the anchor, without those renamed away after they were last seen."""
    at = fs.dated_changes.where(F.col("date") <= fs.anchor)
    seen = at.groupBy("path").agg(F.max("date").alias("last_seen"))
    left = at.where("change_type = 'renamed' and rename_from is not null and rename_from <> ''").groupBy(F.col("rename_from").alias("path")).agg(F.max("date").alias("left_at"))
    gone = seen.join(left, "path").where("left_at > last_seen").select("path")
    return live_at(fs.dated_changes, fs.anchor).join(gone, "path", "left_anti")
