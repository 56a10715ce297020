"""Ownership, knowledge and team analyses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.pairs import shared_counts
from tidemark.sources.facts import FactStore, live_at

HALF_LIFE_DAYS = 220.0
AI_WEIGHTS = {"ai-authored": 0.3, "ai-assisted": 0.7}
REVIEWER_SHARE = 0.5
REVIEWED_FILES = 10


def ownership(fs: FactStore) -> DataFrame:
    """``path``, ``main_author``, ``total_revs``, ``fractal_value`` (1 - sum of squared shares)."""
    per = fs.dated_changes.groupBy("path", "canonical_author").agg(F.count(F.lit(1)).alias("n"))
    return (
        per.groupBy("path")
        .agg(
            F.min_by("canonical_author", F.struct((-F.col("n")).alias("k"), "canonical_author")).alias("main_author"),
            F.sum("n").alias("total_revs"),
            F.sum((F.col("n") * F.col("n")).cast("decimal(38,0)")).alias("squares"),
        )
        .where(F.col("total_revs") >= fs.options.min_revs)
        .select(
            "path", "main_author", "total_revs", (1 - F.col("squares").cast("double") / (F.col("total_revs").cast("double") * F.col("total_revs"))).alias("fractal_value")
        )
    )


def main_developer(fs: FactStore, metric: Column) -> DataFrame:
    """Per path the author with the greatest sum of a metric, and their share of all."""
    per = fs.dated_changes.groupBy("path", "canonical_author").agg(F.sum(metric).alias("metric"), F.count(F.lit(1)).alias("n"))
    return (
        per.groupBy(F.col("path").alias("entity"))
        .agg(
            F.min_by(F.struct("canonical_author", "metric"), F.struct((-F.col("metric")).alias("k"), "canonical_author")).alias("best"),
            F.sum("metric").alias("total"),
            F.sum("n").alias("revs"),
        )
        .where(F.col("revs") >= fs.options.min_revs)
        .select(
            "entity",
            F.col("best.canonical_author").alias("main_dev"),
            F.col("best.metric").alias("metric"),
            "total",
            # hundredths of the binary quotient, half up
            (F.floor(F.col("best.metric").cast("double") / F.greatest(F.col("total"), F.lit(1)) * 100 + 0.5) / 100.0).cast("double").alias("ownership"),
        )
    )


def main_dev(fs: FactStore) -> DataFrame:
    """The author who added most lines."""
    return main_developer(fs, F.col("loc_added"))


def main_dev_by_revs(fs: FactStore) -> DataFrame:
    """The author with most revisions."""
    return main_developer(fs, F.lit(1))


def main_dev_by_deletions(fs: FactStore) -> DataFrame:
    """The author who deleted most lines."""
    return main_developer(fs, F.col("loc_deleted"))


def entity_effort(fs: FactStore) -> DataFrame:
    """Revisions of every author on every path, with the path's total."""
    per = fs.dated_changes.groupBy(F.col("path").alias("entity"), F.col("canonical_author").alias("author")).agg(F.count(F.lit(1)).alias("author_revs"))
    return per.withColumn("total_revs", F.sum("author_revs").over(Window.partitionBy("entity")))


def entity_ownership(fs: FactStore) -> DataFrame:
    """Lines of every author on every path."""
    return fs.dated_changes.groupBy(F.col("path").alias("entity"), F.col("canonical_author").alias("author")).agg(
        F.sum("loc_added").alias("added"), F.sum("loc_deleted").alias("deleted")
    )


def communication(fs: FactStore) -> DataFrame:
    """Pairs of human authors who share at least ``min_shared_revs`` paths, with the strength of the tie."""
    people = fs.changes.select("rev", "path").join(fs.human_commits.select("rev", "canonical_author"), "rev").select("path", "canonical_author").distinct()
    totals = fs.human_commits.groupBy("canonical_author").agg(F.count(F.lit(1)).alias("commits"))
    pairs = shared_counts(people, "path", "canonical_author", fs.options.min_shared_revs).withColumnsRenamed({"a": "author_a", "b": "author_b"})
    joined = pairs.join(totals.select(F.col("canonical_author").alias("author_a"), F.col("commits").alias("ca")), "author_a").join(
        totals.select(F.col("canonical_author").alias("author_b"), F.col("commits").alias("cb")), "author_b"
    )
    both = F.col("ca") + F.col("cb")
    return joined.select("author_a", "author_b", "shared", F.floor(both / 2).alias("average"), (F.lit(200.0) * F.col("shared") / both).alias("strength"))


def _human_lines(fs: FactStore) -> DataFrame:
    """Per path and human author: added lines and revisions."""
    humans = fs.human_commits.select("rev")
    return fs.dated_changes.join(humans, "rev", "left_semi").groupBy("path", "canonical_author").agg(F.sum("loc_added").alias("loc"), F.count(F.lit(1)).alias("n"))


def knowledge_islands(fs: FactStore) -> DataFrame:
    """Live paths whose main author, by lines, has not committed anywhere for a while."""
    o = fs.options
    alive = live_at(fs.dated_changes, fs.anchor)
    often = fs.dated_changes.where(F.col("date") <= fs.anchor).groupBy("path").agg(F.count(F.lit(1)).alias("revs")).where(F.col("revs") >= o.min_revs).select("path")
    before = fs.human_commits.where(F.col("date") <= fs.anchor)
    per = fs.dated_changes.where(F.col("date") <= fs.anchor).join(before.select("rev"), "rev", "left_semi").groupBy("path", "canonical_author").agg(F.sum("loc_added").alias("loc"))
    last = before.groupBy(F.col("canonical_author").alias("main_author")).agg(F.max("date").alias("last_at"))
    share = F.col("loc") / F.sum("loc").over(Window.partitionBy("path")).cast("double")
    shares = per.withColumn("total_loc", F.sum("loc").over(Window.partitionBy("path"))).where("total_loc > 0").withColumn("share", share)
    owners = shares.groupBy("path").agg(
        F.min_by(F.struct("canonical_author", "share"), F.struct((-F.col("loc")).alias("k"), "canonical_author")).alias("main"),
        F.count_if(F.col("share") >= o.substantial_share).alias("substantial"),
        F.max("total_loc").alias("total_loc"),
    )
    return (
        owners.join(alive, "path", "left_semi")
        .join(often, "path", "left_semi")
        .withColumn("main_author", F.col("main.canonical_author"))
        .join(last, "main_author")
        .withColumn("days_since_main_active", F.datediff(fs.anchor, "last_at").cast("long"))
        .where(F.col("days_since_main_active") > o.departed_threshold_days)
        .select(
            F.col("path").alias("entity"),
            "main_author",
            (F.col("main.share") * 100).alias("ownership_pct"),
            "days_since_main_active",
            F.date_format("last_at", "yyyy-MM-dd").alias("last_main_author_commit"),
            (F.col("substantial") - (F.col("main.share") >= o.substantial_share).cast("int")).alias("n_substantial_others"),
            "total_loc",
        )
    )


def knowledge_shares(fs: FactStore, anchor: Column | None = None) -> DataFrame:
    """Decayed knowledge of every human author on every live path: ``path``, ``author``, ``k``, ``k_norm``.

    Added lines count the less the older they are and the more a machine wrote; reviewers and co-authors of
    small commits, named in trailers with a known human's address, get half. ``k_norm`` is null where the
    path's knowledge sums to 0.
    """
    now = fs.anchor if anchor is None else anchor
    age = F.greatest(F.datediff(now, "date"), F.lit(0))
    weight = F.when(F.col("ai_attribution") == "ai-authored", AI_WEIGHTS["ai-authored"]).when(F.col("ai_attribution") == "ai-assisted", AI_WEIGHTS["ai-assisted"]).otherwise(1.0)
    lines = fs.dated_changes.where("change_type <> 'deleted'").join(fs.live_paths, "path", "left_semi")
    worth = (F.col("loc_added") * weight * F.exp(-age / F.lit(HALF_LIFE_DAYS))).alias("k")
    written = lines.join(fs.human_commits.select("rev"), "rev", "left_semi").select("path", F.col("canonical_author").alias("author"), "rev", worth)
    people = fs.aliases.where("not is_bot").groupBy(F.lower("raw_email").alias("email")).agg(F.min("canonical").alias("author"))
    credited = (
        fs.human_commits.where(F.col("nf") <= REVIEWED_FILES)
        .select("rev", F.col("canonical_author").alias("writer"), F.explode(trailer_emails(F.col("message"))).alias("email"))
        .distinct()
        .join(people, "email")
        .where("author <> writer")
        .select("rev", "author")
        .distinct()
    )
    reviewed = written.select("path", "rev", "k").join(credited, "rev").select("path", "author", (F.col("k") * REVIEWER_SHARE).alias("k"))
    total = written.select("path", "author", "k").unionByName(reviewed).groupBy("path", "author").agg(F.sum("k").alias("k"))
    whole = F.sum("k").over(Window.partitionBy("path"))
    return total.select("path", "author", "k", (F.col("k") / F.when(whole > 0, whole)).alias("k_norm"))


def trailer_emails(message: Column) -> Column:
    """Lower-case addresses of Co-authored-by and Reviewed-by lines."""
    rows = F.filter(F.split(F.lower(message), "\n"), lambda x: x.rlike(r"^\s*(co-authored-by|reviewed-by):"))
    return F.array_distinct(F.filter(F.transform(rows, lambda x: F.regexp_extract(x, r"<([^>]+)>", 1)), lambda x: x != ""))


def shares(fs: FactStore) -> DataFrame:
    """Knowledge shares rounded for reporting."""
    return knowledge_shares(fs).select("path", "author", F.round("k", 6).alias("k"), F.round("k_norm", 6).alias("k_norm"))


def doe_scores(fs: FactStore) -> DataFrame:
    """Degree of expertise of every human author on every live path, and whether it makes an expert."""
    now = fs.anchor
    lines = fs.dated_changes.join(fs.human_commits.select("rev"), "rev", "left_semi").join(fs.live_paths, "path", "left_semi").where("change_type <> 'deleted'")
    per = lines.groupBy("path", F.col("canonical_author").alias("author")).agg(
        F.sum("loc_added").alias("adds"), F.max((F.col("change_type") == "added").cast("int")).alias("created"), F.max("date").alias("last_at")
    )
    days = F.greatest(F.datediff(now, "last_at"), F.lit(0))
    doe = (
        F.lit(5.28223)
        + F.lit(0.23173) * F.log((1 + F.col("adds")).cast("double"))
        + F.lit(0.36151) * F.col("created")
        - F.lit(0.19421) * F.log((1 + days).cast("double"))
        - F.lit(0.28761) * F.log(F.greatest(F.col("sloc"), F.lit(1)).cast("double"))
    )
    scored = per.join(fs.files.select("path", "sloc"), "path").withColumn("doe", F.round(doe, 9))
    top = F.max("doe").over(Window.partitionBy("path"))
    return scored.select("path", "author", "doe", ((F.col("doe") >= 1) & (F.col("doe") >= 0.75 * top)).alias("is_expert"))


def active_authors(fs: FactStore) -> DataFrame:
    """Human authors with a commit in the window before the anchor."""
    since = fs.anchor - F.expr(f"INTERVAL {fs.options.window_days} DAYS")
    return fs.human_commits.where((F.col("date") >= since) & (F.col("date") <= fs.anchor)).select(F.col("canonical_author").alias("author")).distinct()


def code_familiarity(fs: FactStore) -> DataFrame:
    """How much of the code, by lines, active authors know. One row."""
    active = active_authors(fs).withColumn("active", F.lit(1))
    known = knowledge_shares(fs).join(active, "author", "left")
    ranked = known.groupBy("path").agg(
        F.sum(F.when(F.col("active") == 1, F.col("k_norm")).otherwise(0.0)).alias("familiar"),
        F.slice(F.sort_array(F.collect_list(F.when(F.col("k_norm") >= 0.2, F.round("k_norm", 9))), asc=False), 1, 2).alias("top"),
    )
    # at most five shares of a path reach 0.2, so the list is short
    sized = fs.files.select("path", "sloc").join(fs.live_paths, "path", "left_semi").join(ranked, "path", "left")
    totals = sized.agg(
        F.round(100 * F.sum(F.col("sloc") * F.coalesce("familiar", F.lit(0.0))) / F.sum("sloc"), 6).alias("familiarity_pct"),
        F.round(100.0 * F.sum(F.when(F.get("top", F.lit(0)) >= 0.8, (F.size("top") < 2).cast("int")).otherwise(0)) / F.count(F.lit(1)), 6).alias("islands_pct"),
    )
    people = fs.human_commits.agg(F.count_distinct("canonical_author").alias("total_authors"))
    now = active_authors(fs).agg(F.count(F.lit(1)).alias("active_authors"))
    # three relations of one row each
    return (
        totals.join(F.broadcast(people))
        .join(F.broadcast(now))
        .select(
            F.lit("repository").alias("scope"),
            "familiarity_pct",
            "active_authors",
            "total_authors",
            "islands_pct",
            F.when(F.col("familiarity_pct") >= fs.options.familiarity_min, "good").otherwise("risky").alias("verdict"),
        )
    )


def team_composition(fs: FactStore) -> DataFrame:
    """Tenure, breadth, activity and onboarding of every human author.

    The core of the team are the authors who, most commits first, make up 80 % of all commits; authors
    are few beside commits, and running sums over them go by ranges of equal counts.
    """
    h = fs.human_commits.where(F.col("date") <= fs.anchor)
    touched = fs.changes.select("rev", "path").join(h.select("rev", "canonical_author"), "rev").groupBy("canonical_author").agg(F.count_distinct("path").alias("files_touched"))
    per = (
        h.groupBy("canonical_author")
        .agg(F.count(F.lit(1)).alias("commits"), F.min("date").alias("first_at"), F.max("date").alias("last_at"))
        .join(touched, "canonical_author", "left")
        .withColumn("files_touched", F.coalesce("files_touched", F.lit(0)))
    )
    # authors with more commits, counted per distinct number of commits
    levels = per.groupBy("commits").agg(F.count(F.lit(1)).alias("n"))
    above = levels.withColumn("before", F.coalesce(F.sum(F.col("commits") * F.col("n")).over(Window.orderBy(F.desc("commits")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = per.agg(F.sum("commits").alias("total"))
    core = per.join(above.select("commits", "before"), "commits").join(F.broadcast(total)).withColumn("is_core", F.col("before") < 0.8 * F.col("total"))
    middle = core.where("is_core").agg(F.percentile("files_touched", F.lit(0.5)).alias("core_breadth"))
    tenure = (F.unix_micros("last_at") - F.unix_micros("first_at")) / F.lit(86_400_000_000.0)
    since = fs.anchor - F.expr(f"INTERVAL {fs.options.window_days} DAYS")
    broad = F.col("files_touched") >= F.col("core_breadth")
    bucket = F.when((F.col("tenure_days") >= 365) & broad, "veteran").when(F.col("tenure_days") >= 90, "experienced").otherwise("onboarded")
    return (
        core.join(F.broadcast(middle))
        .withColumn("tenure_days", tenure)
        .select(
            F.col("canonical_author").alias("author"),
            F.round("tenure_days", 6).alias("tenure_days"),
            bucket.alias("bucket"),
            broad.alias("veteran_breadth_ok"),
            (F.col("last_at") >= since).alias("active"),
            "commits",
            "files_touched",
            "is_core",
        )
    )


def bus_factor(fs: FactStore) -> DataFrame:
    """Fewest authors who made 80 % of a module's commits; the module is the first folder. See also :func:`bus_factor_doe`."""
    if fs.options.knowledge_model == "doe":
        return bus_factor_doe(fs)
    module = F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)).otherwise(F.lit("<root>"))
    humans = fs.human_commits.where("not is_merge").select("rev", "canonical_author")
    per = fs.changes.select("rev", module.alias("module")).distinct().join(humans, "rev").groupBy("module", "canonical_author").agg(F.count(F.lit(1)).alias("n"))
    rank = Window.partitionBy("module").orderBy(F.desc("n"), "canonical_author")
    run = per.withColumn("rank", F.row_number().over(rank)).withColumn("upto", F.sum("n").over(rank.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(Window.partitionBy("module")))
    return run.groupBy("module").agg(
        F.max("total").alias("total_commits"),
        F.min(F.when(F.col("upto") >= 0.8 * F.col("total"), F.col("rank"))).cast("long").alias("bus_factor"),
        F.min_by("canonical_author", "rank").alias("top_contributor"),
        F.round(F.max("n") / F.max("total"), 6).alias("top_contributor_share"),
        F.lit("commits").alias("model"),
    )


def bus_factor_doe(fs: FactStore) -> DataFrame:
    """Authors to lose, the one covering most first, until over half of a module's expert files are bare.

    Files with the same experts are counted together before a module's greedy choice runs, which therefore
    handles one row per distinct set of experts, not one per file, and each only twice.
    """
    module = F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)).otherwise(F.lit("<root>"))
    experts = doe_scores(fs).where("is_expert").groupBy("path").agg(F.sort_array(F.collect_set("author")).alias("who"))
    sets = experts.groupBy(module.alias("module"), "who").agg(F.count(F.lit(1)).alias("files"))

    def lose(key, pdf):
        import pandas as pd

        # a file is an author's as long as the author is there: losing others never changes an author's count
        counts: dict[str, int] = {}
        for people, n in zip(pdf["who"], pdf["files"], strict=True):
            for a in people:
                counts[a] = counts.get(a, 0) + n
        order = sorted(counts, key=lambda a: (-counts[a], a))
        place = {a: k for k, a in enumerate(order, 1)}
        # a file is bare once its last expert is lost
        bare: dict[int, int] = {}
        for people, n in zip(pdf["who"], pdf["files"], strict=True):
            last = max(place[a] for a in people)
            bare[last] = bare.get(last, 0) + n
        files, gone, lost = int(pdf["files"].sum()), 0, 0
        while gone * 2 <= files:
            lost += 1
            gone += bare.get(lost, 0)
        first, first_share = order[0], counts[order[0]] / files
        return pd.DataFrame({"module": [key[0]], "total_commits": [files], "bus_factor": [lost], "top_contributor": [first], "top_contributor_share": [round(first_share, 6)], "model": ["doe"]})

    return sets.groupBy("module").applyInPandas(
        lose, "module string, total_commits long, bus_factor long, top_contributor string, top_contributor_share double, model string"
    )


def pair_programming(fs: FactStore) -> DataFrame:
    """Pairs of addresses that share the credit of at least ``min_shared_revs`` commits."""
    machines = fs.aliases.where("is_bot").select(F.lower("raw_email").alias("email")).distinct()
    people = (
        fs.commits.where("not is_merge and author_email is not null")
        .select("rev", F.explode(F.array_union(F.array(F.lower("author_email")), F.coalesce(co_author_emails(F.col("message")), F.array().cast("array<string>")))).alias("email"))
        .join(machines, "email", "left_anti")
    )
    # the trailers of one message bound the group
    joint = people.groupBy("rev").agg(F.sort_array(F.collect_set("email")).alias("who")).where(F.size("who") > 1)
    pairs = joint.select("who", F.posexplode("who").alias("pos", "author_a")).select("author_a", F.explode(F.slice("who", F.col("pos") + 2, F.size("who"))).alias("author_b"))
    return pairs.groupBy("author_a", "author_b").agg(F.count(F.lit(1)).alias("pair_commits")).where(F.col("pair_commits") >= fs.options.min_shared_revs)


def co_author_emails(message: Column) -> Column:
    """Lower-case addresses of Co-authored-by lines."""
    rows = F.filter(F.split(F.lower(message), "\n"), lambda x: x.rlike(r"^\s*co-authored-by:"))
    return F.array_distinct(F.filter(F.transform(rows, lambda x: F.regexp_extract(x, r"<([^>]+)>", 1)), lambda x: x != ""))


def owner_activity(fs: FactStore, paths: DataFrame) -> DataFrame:
    """For given paths: the main human author by lines and the days since they last committed."""
    per = _human_lines(fs).join(paths.select("path").distinct(), "path", "left_semi")
    last = fs.human_commits.groupBy(F.col("canonical_author").alias("main_author")).agg(F.max("date").alias("last_at"))
    main = per.groupBy("path").agg(F.min_by("canonical_author", F.struct((-F.col("loc")).alias("k"), "canonical_author")).alias("main_author"))
    return main.join(last, "main_author").select("path", "main_author", F.datediff(fs.anchor, "last_at").cast("long").alias("days_since_main_active"))


def top_active_share(fs: FactStore) -> DataFrame:
    """Per path the greatest share of knowledge that an active author holds; 0 if none."""
    known = knowledge_shares(fs).join(active_authors(fs).withColumn("active", F.lit(True)), "author", "left")
    return known.groupBy("path").agg(F.round(F.coalesce(F.max(F.when(F.col("active"), F.col("k_norm"))), F.lit(0.0)), 9).alias("top_active_share"))
