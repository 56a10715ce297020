"""Comparing two moments of a history, overlaying edits, briefing on paths, and checking quoted numbers."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import churn, coupling, ownership, rankings, structure
from tidemark.sources.facts import FactStore, live_at

BRIEFED_PATHS = 20
SMALL_NUMBER = 12


def store_at(fs: FactStore, moment: str) -> FactStore:
    """The same history up to a moment; files are those alive then."""
    at = F.lit(moment).cast("timestamp")
    commits = fs.commits.where(F.col("date") <= at)
    changes = fs.table("changes").join(commits.select("rev"), "rev", "left_semi")
    alive = live_at(fs.dated_changes, at)
    files = fs.table("blobs").join(alive, "path", "left_semi")
    return fs.replacing(fs.options.but(as_of=moment), commits=commits, changes=changes, blobs=files)


def diff_hotspots(before: FactStore, after: FactStore, top: int = 20, increase: float = 1.0) -> DataFrame:
    """Paths that entered the ``top`` hotspots or whose score rose by ``increase``: ``path``, ``was``, ``now``, ``reason``."""

    def ranked(fs: FactStore, mark: str) -> DataFrame:
        hot = rankings.hotspots(fs).select("path", F.col("hotspot_score").alias(mark))
        # at most `top` rows carry a rank
        best = hot.orderBy(F.desc(mark), "path").limit(top).select("path", F.lit(True).alias(f"top_{mark}"))
        return hot.join(F.broadcast(best), "path", "left")

    both = ranked(before, "was").join(ranked(after, "now"), "path", "full")
    entered = F.coalesce("top_now", F.lit(False)) & ~F.coalesce("top_was", F.lit(False))
    rose = F.col("now") - F.coalesce("was", F.lit(0.0)) >= increase
    return both.withColumn("reason", F.when(entered, "entered").when(rose, "rose")).where("reason is not null").select("path", "was", "now", "reason")


def _text(moment: datetime) -> str:
    return moment.isoformat(sep=" ")


def year_before(fs: FactStore) -> str:
    """The moment a year before the one that analyses look back from."""
    day = fs.moment.day - (fs.moment.month == 2 and fs.moment.day == 29)
    return _text(fs.moment.replace(year=fs.moment.year - 1, day=day))


def diff_of_year(fs: FactStore) -> DataFrame:
    """Hotspots a year before the anchor against the anchor."""
    return diff_hotspots(store_at(fs, year_before(fs)), store_at(fs, _text(fs.moment)))


def new_clone_families(fs: FactStore, before: str, after: str) -> DataFrame:
    """Duplicated fragments with two members alive at the later moment but not at the earlier: ``fingerprint``, ``was``, ``now``."""
    members = fs.clones.select("fingerprint", "path", "start_line")
    was = members.join(live_at(fs.dated_changes, F.lit(before).cast("timestamp")), "path", "left_semi").groupBy("fingerprint").agg(F.count(F.lit(1)).alias("was"))
    now = members.join(live_at(fs.dated_changes, F.lit(after).cast("timestamp")), "path", "left_semi").groupBy("fingerprint").agg(F.count(F.lit(1)).alias("now"))
    both = now.join(was, "fingerprint", "left").withColumn("was", F.coalesce("was", F.lit(0)))
    return both.where("now >= 2 and was < 2")


def clone_families_of_year(fs: FactStore) -> DataFrame:
    """New duplicated fragments within the year before the anchor."""
    return new_clone_families(fs, year_before(fs), _text(fs.moment))


def overlay(fs: FactStore, edited: DataFrame, deleted: DataFrame | None = None) -> FactStore:
    """The store with edited files (``path``, ``lang``, ``content``) in place of its own and deleted ones gone."""
    new = edited.select("path", "lang", "content")
    kept = fs.table("blobs").select("path", "lang", "content").join(new.select("path"), "path", "left_anti")
    if deleted is not None:
        kept = kept.join(deleted.select("path"), "path", "left_anti")
    return fs.replacing(blobs=kept.unionByName(new))


def change_set_report(fs: FactStore, edited: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """What a change set does to its files: ``path``, ``health_before``, ``health_after``, ``delta``, ``newly_cyclic``."""
    after = overlay(fs, edited, deleted)
    touched = edited.select("path").distinct()
    a = rankings.code_health(fs).select("path", F.col("score").alias("health_before"))
    b = rankings.code_health(after).select("path", F.col("score").alias("health_after"))
    was = structure.cycle_members(fs).select("path", F.lit(True).alias("was_cyclic"))
    now = structure.cycle_members(after).select("path", F.lit(True).alias("is_cyclic"))
    joined = touched.join(a, "path", "left").join(b, "path", "left").join(was, "path", "left").join(now, "path", "left")
    return joined.select(
        "path",
        "health_before",
        "health_after",
        (F.col("health_after") - F.col("health_before")).alias("delta"),
        (F.coalesce("is_cyclic", F.lit(False)) & ~F.coalesce("was_cyclic", F.lit(False))).alias("newly_cyclic"),
    )


def example_change_set(fs: FactStore) -> DataFrame:
    """A change set that doubles the Python files of one folder: an example of an overlay."""
    edited = fs.table("blobs").where("lang = 'python' and content is not null and path like 'libs/%'").select("path", "lang", F.concat("content", F.lit("\n"), "content").alias("content"))
    return change_set_report(fs, edited).select("path", F.round("health_before", 6).alias("health_before"), F.round("health_after", 6).alias("health_after"), F.round("delta", 6).alias("delta"), "newly_cyclic")


def change_context(fs: FactStore, paths: DataFrame) -> DataFrame:
    """A briefing on at most twenty paths: revisions, main author, window churn, closest partners."""
    # the first twenty paths in order; a briefing is a report for people
    asked = F.broadcast(paths.select("path").distinct().orderBy("path").limit(BRIEFED_PATHS))
    since = fs.anchor - F.expr(f"INTERVAL {fs.options.window_days} DAYS")
    recent = (F.col("date") >= since) & (F.col("date") <= fs.anchor)
    own = fs.dated_changes.join(asked, "path", "left_semi").groupBy("path").agg(
        F.count(F.lit(1)).alias("revisions"), F.coalesce(F.sum(F.when(recent, F.col("loc_added") + F.col("loc_deleted"))), F.lit(0)).alias("window_churn")
    )
    owners = ownership.ownership(fs.with_options(min_revs=1)).select("path", "main_author")
    ranked = Window.partitionBy("path").orderBy(F.desc("degree"), "partner")
    near = coupling.partner_index(coupling.coupling(fs)).join(asked, "path", "left_semi").withColumn("degree", F.round("degree", 6)).withColumn("k", F.row_number().over(ranked)).where("k <= 3")
    partners = near.groupBy("path").agg(F.concat_ws(", ", F.transform(F.sort_array(F.collect_list(F.struct("k", "partner"))), lambda x: x["partner"])).alias("partners"))
    return asked.join(own, "path", "left").join(owners, "path", "left").join(partners, "path", "left").select("path", F.coalesce("revisions", F.lit(0)).alias("revisions"), F.coalesce("window_churn", F.lit(0)).alias("window_churn"), "main_author", F.coalesce("partners", F.lit("")).alias("partners"))


def context_of_latest(fs: FactStore) -> DataFrame:
    """A briefing on the paths of the ten newest commits."""
    newest = fs.commits.where("seq < 10").select("rev")
    return change_context(fs, fs.changes.join(newest, "rev", "left_semi"))


def unsupported_numbers(text: Column, facts: Column) -> Column:
    """Numbers of a text that no fact supports.

    A number is supported if a fact equals it at the precision it is quoted with, if it is a share whose
    percentage is quoted, or if it is a whole number of at most 12.
    """
    quoted = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![\w.])(\d+(?:\.\d+)?)(?![\w.]*\w)"), F.lit(1)))

    def supported(q: Column) -> Column:
        digits = F.length(F.regexp_extract(q, r"\.(\d+)$", 1))
        unit = F.pow(F.lit(10.0), digits.cast("double"))
        value = q.try_cast("double")

        def equal(v: Column) -> Column:
            return F.abs(F.rint(v * unit) - F.rint(value * unit)) < 0.5

        small = (digits == 0) & (value <= SMALL_NUMBER)
        return small | F.exists(facts, lambda v: equal(v) | equal(v * 100))

    return F.filter(quoted, lambda q: ~F.coalesce(supported(q), F.lit(False)))


def citation_check(statements: DataFrame, facts: DataFrame, key: str, text: str = "text", value: str = "value") -> DataFrame:
    """Statements with the numbers no fact of their key supports: ``key``, ``text``, ``unsupported``.

    The facts of one key are gathered as an array; a key is one report, whose facts are few.
    """
    known = facts.where(F.col(value).isNotNull()).groupBy(key).agg(F.collect_set(F.col(value).cast("double")).alias("_facts"))
    joined = statements.join(known, key, "left").withColumn("_facts", F.coalesce("_facts", F.array().cast("array<double>")))
    return joined.select(key, text, unsupported_numbers(F.col(text), F.col("_facts")).alias("unsupported"))


def gate_citations(fs: FactStore) -> DataFrame:
    """Gate reports whose first line, a limit and a value, is quoted in the rest: ``doc_id``, ``quoted``, ``unsupported``."""
    docs = fs.table("documents").where("doc_id is not null and kind = 'gate_report' and text like 'gate:%'").select("doc_id", "text").distinct()
    head = F.regexp_extract_all(F.substring_index("text", "\n", 1), F.lit(r"(\d+\.\d+)"), F.lit(1))
    facts = docs.select("doc_id", F.explode(head).alias("value"))
    checked = citation_check(docs, facts.withColumn("value", F.col("value").cast("double")), "doc_id")
    return checked.groupBy("doc_id").agg(F.max(F.size("unsupported")).cast("long").alias("unsupported"))


def band_transitions(fs: FactStore) -> DataFrame:
    """Changes of the architecture band between sampled commits: into red or out of green is a regression."""
    t = structure.architecture_health(fs)
    order = Window.orderBy("k")  # a handful of samples
    moved = t.withColumn("before", F.lag("band").over(order)).where("before is not null and before <> band")
    worse = (F.col("band") == "red") | (F.col("before") == "green")
    return moved.select("k", "rev", "before", F.col("band").alias("after"), F.when(worse, "regressed").otherwise("improved").alias("change"))


def owners_to_brief(fs: FactStore) -> DataFrame:
    """Main authors of the files alive at the anchor that changed most in the last window."""
    velocity = churn.hotspot_velocity(fs.with_options(min_revs=2)).select("path", "acceleration")
    return velocity.join(ownership.ownership(fs.with_options(min_revs=1)).select("path", "main_author"), "path").groupBy("main_author").agg(F.count(F.lit(1)).alias("paths"), F.round(F.sum("acceleration"), 6).alias("acceleration"))


def delta_verdict(delta: DataFrame) -> DataFrame:
    """The share of good weight among good and bad, and what it says: degrading below 40 with anything bad, improving above 70. One row."""
    total = delta.agg(*[F.coalesce(F.sum(F.when(F.col("outcome") == o, F.col("weight"))), F.lit(0)).alias(o) for o in ("good", "bad")])
    ratio = 100.0 * F.col("good") / F.nullif(F.col("good") + F.col("bad"), F.lit(0))
    verdict = F.when((ratio < 40) & (F.col("bad") > 0), "degrading").when(ratio > 70, "improving").otherwise("steady")
    return total.select(F.round(ratio, 6).alias("ratio"), verdict.alias("verdict"))


def diff_gates(report: DataFrame, limits: dict[str, float], hotspots: DataFrame | None = None, delta: DataFrame | None = None) -> DataFrame:
    """Gates of a change set: ``delta_code_health_min``, ``new_file_health_min``, ``no_new_cycles``; with the
    ``hotspots`` of :func:`diff_hotspots`, ``new_hotspot_max``; with the ``delta`` of functions, ``delta_health_min``
    and ``deny_degrading_verdict``.
    """
    from tidemark.operators.gates import violations

    parts: Sequence[DataFrame] = []
    if "delta_code_health_min" in limits:
        parts = [*parts, violations(report, "delta_code_health_min", "delta", limits["delta_code_health_min"], above=False)]
    if "new_file_health_min" in limits:
        parts = [*parts, violations(report.where("health_before is null"), "new_file_health_min", "health_after", limits["new_file_health_min"], above=False)]
    if limits.get("no_new_cycles"):
        parts = [*parts, violations(report.withColumn("n", F.col("newly_cyclic").cast("int")), "no_new_cycles", "n", 0, above=True)]
    none = F.lit(None).cast("string")
    if hotspots is not None and "new_hotspot_max" in limits:
        entered = hotspots.where("reason = 'entered'").agg(F.count(F.lit(1)).alias("n"))
        parts = [*parts, violations(entered, "new_hotspot_max", "n", limits["new_hotspot_max"], above=True, path=none)]
    if delta is not None and "delta_health_min" in limits:
        parts = [*parts, violations(delta_verdict(delta), "delta_health_min", "ratio", limits["delta_health_min"], above=False, path=none)]
    if delta is not None and limits.get("deny_degrading_verdict"):
        bad = delta_verdict(delta).withColumn("n", (F.col("verdict") == "degrading").cast("int"))
        parts = [*parts, violations(bad, "deny_degrading_verdict", "n", 0, above=True, path=none)]
    if not parts:
        return report.sparkSession.createDataFrame([], "gate string, path string, actual double, threshold double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
