"""How work is delivered: lead times, branches, rework, releases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tidemark.session import drop_staged, stage_table
from tidemark.sources.facts import FactStore
from tidemark.sources.readers import attribution

BRANCH_DEPTH = 200
BRANCH_DAYS = 90
CAVEATS = {
    "needs merges; squashed branches are not seen": ("batch_size_files", "batch_size_loc", "branch_duration_hours"),
    "from writing to landing, not to release": ("lead_proxy_hours",),
    "lines that moved between commits are not followed": ("rework_pct",),
    "different addresses; a stand-in for patches that others apply": ("landed_by_other_pct",),
}


def lead_time(fs: FactStore) -> DataFrame:
    """Seconds and days from writing to landing of every commit that is no merge; days are never negative."""
    seconds = ((F.unix_micros("committer_date") - F.unix_micros("date")) / F.lit(1e6)).alias("lead_time_seconds")
    made = fs.commits.where("not is_merge").select("rev", "canonical_author", F.date_format("date", "yyyy-MM-dd").alias("author_date"), F.date_format("committer_date", "yyyy-MM-dd").alias("committer_date"), seconds)
    return made.withColumn("lead_time_days", F.greatest("lead_time_seconds", F.lit(0.0)) / 86400)


def mainline(fs: FactStore) -> DataFrame:
    """Commits on the first-parent way from the newest commit, by doubling jumps: ``rev``."""
    step = stage_table(fs.parents.where("position = 0").select("rev", F.col("parent_rev").alias("ptr")))
    head = fs.commits.groupBy().agg(F.max_by("rev", F.struct("date", -F.col("seq"))).alias("rev"))
    line = stage_table(head)
    known = 1
    while True:
        # everything within 2^k steps, then within 2^(k+1)
        longer = stage_table(line.unionByName(line.join(step, "rev").select(F.col("ptr").alias("rev"))).distinct())
        drop_staged(line)
        line, count = longer, longer.count()
        if count == known:
            drop_staged(step)
            return line
        known = count
        far = step.select(F.col("rev").alias("ptr"), F.col("ptr").alias("far"))
        doubled = stage_table(step.join(far, "ptr").select("rev", F.col("far").alias("ptr")))
        drop_staged(step)
        step = doubled


def branch_commits(fs: FactStore) -> DataFrame:
    """Commits that each merge brought in: ``merge``, ``rev``.

    From the merge's second parent first parents are followed until the main line, at most 200 steps and
    90 days back. Jumps double their length in every round, so that eight rounds go all the way for all
    merges together.
    """
    c = fs.commits.select("rev", "date")
    line = mainline(fs)
    first = fs.parents.where("position = 0").select("rev", F.col("parent_rev").alias("next"))
    merges = fs.parents.where("position = 1").select(F.col("rev").alias("merge"), F.col("parent_rev").alias("rev"))
    floor = c.select(F.col("rev").alias("merge"), (F.col("date") - F.expr(f"INTERVAL {BRANCH_DAYS} DAYS")).alias("floor"))
    off = stage_table(c.join(line, "rev", "left_anti").select("rev"))
    jump = stage_table(first.join(off, "rev").join(off.withColumnRenamed("rev", "next"), "next").select("rev", F.col("next").alias("far")))
    at = stage_table(merges.join(off, "rev").select("merge", "rev", F.lit(0).alias("depth")))
    length = 1
    while length < BRANCH_DEPTH:
        onward = at.join(jump, "rev").select("merge", F.col("far").alias("rev"), (F.col("depth") + length).alias("depth")).where(F.col("depth") < BRANCH_DEPTH)
        reached = stage_table(at.unionByName(onward))
        doubled = stage_table(jump.join(jump.select(F.col("rev").alias("far"), F.col("far").alias("farther")), "far").select("rev", F.col("farther").alias("far")))
        drop_staged(at, jump)
        at, jump, length = reached, doubled, length * 2
    # a walk ends at its first commit before the floor
    dated = at.join(c, "rev").join(floor, "merge")
    ends = dated.where("date < floor or date is null or floor is null").groupBy("merge").agg(F.min("depth").alias("end"))
    return dated.join(ends, "merge", "left").where("end is null or depth < end").select("merge", "rev")


def _spread(df: DataFrame, metric: str, value: str) -> DataFrame:
    """``metric``, ``p50``, ``p75``, ``p90``, ``n``; no row without values."""
    levels = F.percentile(value, F.array(F.lit(0.5), F.lit(0.75), F.lit(0.9))).alias("p")
    counted = df.where(F.col(value).isNotNull()).agg(levels, F.count(F.lit(1)).alias("n")).where("n > 0")
    return counted.select(F.lit(metric).alias("metric"), *[F.round(F.col("p")[k], 6).alias(name) for k, name in enumerate(("p50", "p75", "p90"))], "n")


def rework(fs: FactStore) -> DataFrame:
    """Lines written in the window before the anchor, and how many of them were soon rewritten. One row.

    A region is rewritten by a later one on the same path within ``rework_window_days`` whose old side
    overlaps it. Regions of one path meet in bins of that many days, so that a path with very many regions
    is spread over its history instead of being paired with itself.
    """
    days = fs.options.rework_window_days
    since = fs.anchor - F.expr(f"INTERVAL {fs.options.window_days} DAYS")
    h = fs.hunks.join(fs.commits.select("rev", "date"), "rev")
    bin_of = F.floor(F.unix_date(F.to_date("date")) / days)
    written = h.where((F.col("date") >= since) & (F.col("date") <= fs.anchor)).select("rev", "path", "new_start", "new_lines", F.col("date").alias("at"), F.explode(F.array(bin_of, bin_of + 1)).alias("bin"))
    later = h.where("old_lines > 0").select("path", F.col("rev").alias("by"), "old_start", "old_lines", F.col("date").alias("then"), bin_of.alias("bin"))
    overlap = F.least(F.col("new_start") + F.col("new_lines"), F.col("old_start") + F.col("old_lines")) - F.greatest("new_start", "old_start")
    hit = (
        written.join(later, ["path", "bin"])
        .where((F.col("then") > F.col("at")) & (F.datediff("then", "at") <= days))
        .withColumn("overlap", overlap)
        .where("overlap > 0")
        .groupBy("rev", "path")
        .agg(F.sum("overlap").alias("overlap"))
    )
    base = h.where((F.col("date") >= since) & (F.col("date") <= fs.anchor)).select("rev", "path", "new_lines")
    joined = base.join(hit, ["rev", "path"], "left")
    return joined.agg(F.coalesce(F.sum("new_lines"), F.lit(0)).alias("written"), F.coalesce(F.sum(F.least("overlap", "new_lines")), F.lit(0)).alias("reworked"), F.count(F.lit(1)).alias("n"))


def delivery_metrics(fs: FactStore) -> DataFrame:
    """Spread of batch sizes, branch and lead times, and shares of rework and foreign landing."""
    b = stage_table(branch_commits(fs))
    size = b.join(fs.changes.select("rev", "path", "loc_added", "loc_deleted"), "rev").groupBy("merge").agg(F.count_distinct("path").cast("double").alias("files"), F.sum(F.col("loc_added") + F.col("loc_deleted")).cast("double").alias("loc"))
    c = fs.commits.select("rev", "date")
    ends = c.select(F.col("rev").alias("merge"), F.unix_micros("date").alias("end"))
    hours = (F.floor(F.col("end") / 3_600_000_000) - F.floor(F.col("start") / 3_600_000_000)).cast("double")
    span = b.join(c, "rev").groupBy("merge").agg(F.min(F.unix_micros("date")).alias("start")).join(ends, "merge").select(hours.alias("hours"))
    late = F.floor(F.unix_micros("committer_date") / 3_600_000_000) - F.floor(F.unix_micros("date") / 3_600_000_000)
    lead = fs.commits.where("not is_merge").select(F.when(late > 0, late.cast("double")).alias("hours"))
    again = rework(fs).where("n > 0").select(F.lit("rework_pct").alias("metric"), F.round(100.0 * F.col("reworked") / F.nullif("written", F.lit(0)), 6).alias("p50"), "n")
    other = fs.commits.where("not is_merge and author_email is not null and committer_email is not null").agg(F.count_if(F.lower("author_email") != F.lower("committer_email")).alias("k"), F.count(F.lit(1)).alias("n")).where("n > 0")
    landed = other.select(F.lit("landed_by_other_pct").alias("metric"), F.round(100.0 * F.col("k") / F.col("n"), 6).alias("p50"), "n")
    out = _spread(size, "batch_size_files", "files").unionByName(_spread(size, "batch_size_loc", "loc")).unionByName(_spread(span, "branch_duration_hours", "hours")).unionByName(_spread(lead, "lead_proxy_hours", "hours"))
    every = out.unionByName(again, allowMissingColumns=True).unionByName(landed, allowMissingColumns=True)
    return every.withColumn("caveat", F.coalesce(*[F.when(F.col("metric").isin(*names), F.lit(text)) for text, names in CAVEATS.items()]))


def tags_of(fs: FactStore) -> DataFrame:
    """Release tags that match the glob, with the days since the one before. Tags are few."""
    pattern = "^" + "".join({"*": ".*", "?": "."}.get(ch, "\\" + ch if not ch.isalnum() else ch) for ch in fs.options.release_tag_glob) + "$"
    kept = fs.tags.where(F.col("tag").rlike(pattern))
    return kept.select("tag", "date", F.datediff("date", F.lag("date").over(Window.orderBy("date", "tag"))).cast("long").alias("days_since_prev"))


def release_cadence(fs: FactStore) -> DataFrame:
    """Release tags with their distance: ``tag``, ``date``, ``days_since_prev``."""
    return tags_of(fs).select("tag", F.date_format("date", "yyyy-MM-dd").alias("date"), "days_since_prev")


def release_trend(fs: FactStore) -> DataFrame:
    """Median and interquartile range of release gaps and whether they grow or shrink. One row."""
    gaps = tags_of(fs).where("days_since_prev is not null").withColumn("k", F.row_number().over(Window.orderBy("date", "tag")))
    r = gaps.agg(
        F.percentile("days_since_prev", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"),
        F.regr_slope(F.col("days_since_prev").cast("double"), F.col("k").cast("double")).alias("slope"),
        F.count(F.lit(1)).alias("n"),
    )
    median = F.col("q")[1]
    trend = F.when(F.col("slope") > 0.1 * median, "slowing").when(F.col("slope") < -0.1 * median, "accelerating").otherwise("steady")
    return r.select("n", F.round(median, 6).alias("median_days"), F.round(F.col("q")[2] - F.col("q")[0], 6).alias("iqr_days"), F.round("slope", 9).alias("slope"), trend.alias("trend"))


def _before(*by: str) -> WindowSpec:
    """What lies strictly before the moment ``at`` of a row; equal moments do not count."""
    return Window.partitionBy(*by).orderBy("at").rangeBetween(Window.unboundedPreceding, -1)


def _experience(fs: FactStore, fix_pattern: str) -> DataFrame:
    """Every commit with its author's earlier commits, plain (``exp``) and weighed by years (``rexp``). An unknown author has none."""
    needed = fs.table("commits").where("rev is not null").select("rev", "canonical_author", "date", F.coalesce(F.col("message").rlike(fix_pattern), F.lit(False)).alias("fix"))
    c = needed.dropDuplicates(["rev"]).withColumns({"at": F.unix_micros("date"), "y": F.year("date")})
    per_year = c.groupBy("canonical_author", "y").agg(F.count(F.lit(1)).alias("n"))
    years = per_year.groupBy("canonical_author").agg(F.sort_array(F.collect_list(F.struct("y", "n"))).alias("years"))
    older = F.aggregate(F.filter("years", lambda b: b["y"] < F.col("y")), F.lit(0.0), lambda total, b: total + b["n"] / (1 + F.col("y") - b["y"]))
    counted = c.withColumns({"exp": F.count("at").over(_before("canonical_author")), "same_year": F.count("at").over(_before("canonical_author", "y"))})
    known = F.col("canonical_author").isNotNull()
    return counted.join(years, "canonical_author", "left").select(
        "rev", "canonical_author", "date", "fix", F.when(known, F.col("exp")).otherwise(0).alias("exp"), F.round(F.when(known, F.col("same_year") + F.coalesce(older, F.lit(0.0))).otherwise(0.0), 6).alias("rexp")
    )


def _commit_work(fs: FactStore, fix_pattern: str) -> DataFrame:
    """A row for each commit with changes: a number, what its own paths and its author tell, its top folders, and keys of its paths.

    The number and keys of 16 bytes stand for texts in what is moved later.
    """
    changes = fs.changes.groupBy("rev").agg(F.collect_list(F.struct("path", "loc_added", "loc_deleted")).alias("x"))
    tops = F.array_distinct(F.transform("x", lambda x: F.when(F.contains(x["path"], F.lit("/")), F.substring_index(x["path"], "/", 1)).otherwise(F.lit(""))))
    folders = F.array_distinct(F.transform("x", lambda x: F.regexp_extract(x["path"], r"^(.*)/[^/]*$", 1)))
    total = lambda c: F.aggregate("x", F.lit(0).cast("long"), lambda t, x: t + x[c])
    share = lambda x: x["loc_added"] / F.col("la")
    entropy = F.aggregate(F.filter("x", lambda x: x["loc_added"] > 0), F.lit(0.0), lambda t, x: t - share(x) * F.log2(share(x)))
    return (
        changes.withColumns({"la": total("loc_added"), "ld": total("loc_deleted")})
        .join(_experience(fs, fix_pattern), "rev")
        .select(
            F.monotonically_increasing_id().alias("cid"),
            *["rev", "canonical_author", "date", "fix", "exp", "rexp", "la", "ld"],
            F.size(tops).cast("long").alias("ns"),
            F.size(folders).cast("long").alias("nd"),
            F.size("x").cast("long").alias("nf"),
            F.round(entropy, 6).alias("entropy"),
            tops.alias("tops"),
            F.transform("x", lambda x: F.unhex(F.md5(x["path"].cast("binary")))).alias("paths"),
        )
    )


def _path_history(work: DataFrame, hot_paths: int = 8) -> DataFrame:
    """What went before each commit on its paths: ``cid``, ``nuc`` (changes), ``age`` (mean days since the last), ``ndev`` (distinct authors).

    The busiest paths are counted as sets: each set of them that occurs in a commit (255 at most) has a running
    sum over the first touches of all authors, so that no commit meets all authors of a path that everyone
    touches. Of its other paths a commit gathers those earlier authors only whom its set had not seen.
    """
    counts = work.select(F.explode("paths").alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    hot = [F.lit(bytearray(r["path"])) for r in counts.orderBy(F.desc("n"), "path").limit(hot_paths).collect()]
    bits = F.lit(0).cast("long")
    for k, key in enumerate(hot):
        bits = bits + F.when(F.array_contains("paths", key), 1 << k).otherwise(0)
    marked = work.select("cid", "canonical_author", F.unix_micros("date").alias("at"), "paths", bits.alias("bits"))
    never = F.lit(None).cast("long")

    def first_touch(times: Column) -> Column:
        return F.array_min(F.array(never, *[F.when(F.col("bits").bitwiseAND(F.lit(1 << k)) != 0, times[k]) for k in range(len(hot))]))

    touched = [F.min(F.when(F.col("bits").bitwiseAND(F.lit(1 << k)) != 0, F.col("at"))) for k in range(len(hot))]
    per_author = marked.where("canonical_author is not null").groupBy("canonical_author").agg(F.array(never, *touched).alias("all"))
    # where an author touched none of the busiest paths, nothing is carried along
    met = F.slice("all", 2, len(hot)) if hot else F.array().cast("array<long>")
    authors = stage_table(per_author.select("canonical_author", F.monotonically_increasing_id().alias("aid"), F.when(F.size(F.array_compact("all")) > 0, met).alias("times")))
    rows = marked.join(authors, "canonical_author", "left").select("cid", "aid", "at", "bits", "times", F.explode("paths").alias("path"))
    # everything about a path comes from one exchange of its changes
    day = lambda at: F.to_date(F.timestamp_micros(at))
    since = F.datediff(day("at"), day(F.max("at").over(_before("path"))))
    counted = rows.withColumns({"prior": F.count("at").over(_before("path")), "days": since})
    is_hot = F.col("path").isin(*hot) if hot else F.lit(False)
    nth = F.row_number().over(Window.partitionBy("path", "aid").orderBy(F.col("at").asc_nulls_last()))
    newcomer = F.when((F.col("nth") == 1) & F.col("aid").isNotNull() & F.col("at").isNotNull(), F.struct("aid", F.col("at").alias("met_at"), "times"))
    # at most the authors of one path that is not among the busiest
    met_there = counted.where(~is_hot).withColumn("nth", nth).withColumn("met", F.collect_list(newcomer).over(Window.partitionBy("path")))
    unseen = F.filter("met", lambda x: (x["met_at"] < F.col("at")) & F.coalesce(first_touch(x["times"]) >= F.col("at"), F.lit(True)))
    extra = F.transform(unseen, lambda x: x["aid"])
    others = met_there.select("cid", "prior", "days", extra.alias("extra")).withColumn("extra", F.when(F.size("extra") > 0, F.col("extra")))
    busy = counted.where(is_hot).select("cid", "prior", "days", F.lit(None).cast("array<long>").alias("extra"))
    # rows of a commit come from as many places, so sums made before they meet would only be larger
    per = others.unionByName(busy).repartition("cid").groupBy("cid").agg(
        F.sum("prior").alias("nuc"),
        F.round(F.coalesce(F.avg("days"), F.lit(0.0)), 6).alias("age"),
        F.size(F.array_distinct(F.flatten(F.collect_list("extra")))).cast("long").alias("extra"),
    )
    in_set = marked.where("bits > 0")
    # 255 rows at most
    occurring = F.broadcast(in_set.select("bits").distinct())
    arrivals = authors.where("times is not null").join(occurring).select("bits", first_touch(F.col("times")).alias("at")).where("at is not null")
    new = arrivals.groupBy("bits", "at").agg(F.count(F.lit(1)).alias("new")).select(F.lit(None).cast("long").alias("cid"), "bits", "at", "new")
    moments = in_set.select("cid", "bits", "at", F.lit(0).cast("long").alias("new")).unionByName(new)
    devs = moments.withColumn("devs", F.sum(F.when(F.col("at").isNotNull(), F.col("new"))).over(_before("bits"))).where("cid is not null").select("cid", F.coalesce("devs", F.lit(0)).alias("devs"))
    return per.join(devs, "cid", "left").select("cid", "nuc", "age", (F.col("extra") + F.coalesce("devs", F.lit(0))).alias("ndev"))


def kamei_features(fs: FactStore, fix_pattern: str = r"(?i)\b(fix|bug|defect|patch|repair)\w*") -> DataFrame:
    """Change-risk features of every commit with changes.

    Sizes and spreads come from the commit's own paths. ``nuc`` (earlier changes of its paths), ``age`` (mean
    days since they changed) and ``ndev`` (earlier authors) look strictly back in time; experience counts the
    author's earlier commits (``exp``), weighs them by years (``rexp``), and takes the most of one top folder
    (``sexp``). Earlier counts come from windows per path or author.
    """
    work = stage_table(_commit_work(fs, fix_pattern))
    tops = work.where("canonical_author is not null").select("cid", "canonical_author", F.unix_micros("date").alias("at"), F.explode("tops").alias("top"))
    sexp = tops.withColumn("s", F.count("at").over(_before("canonical_author", "top"))).groupBy("cid").agg(F.max("s").alias("sexp"))
    return (
        work.drop("canonical_author", "date", "tops", "paths")
        .join(_path_history(work), "cid")
        .join(sexp, "cid", "left")
        .select("rev", "ns", "nd", "nf", "entropy", "la", "ld", F.lit(0.0).alias("lt"), "fix", "ndev", "age", "nuc", "exp", "rexp", F.coalesce("sexp", F.lit(0)).alias("sexp"))
    )


def monthly_trends(fs: FactStore) -> DataFrame:
    """Commits, authors and lines per month."""
    lines = fs.changes.groupBy("rev").agg(F.sum("loc_added").alias("added"), F.sum("loc_deleted").alias("deleted"))
    return (
        fs.commits.join(lines, "rev", "left")
        .groupBy(F.date_format("date", "yyyy-MM").alias("month"))
        .agg(F.count(F.lit(1)).alias("commits"), F.count_distinct("canonical_author").alias("authors"), F.coalesce(F.sum("added"), F.lit(0)).alias("added"), F.coalesce(F.sum("deleted"), F.lit(0)).alias("deleted"))
    )


def control_charts(fs: FactStore) -> DataFrame:
    """Monthly commits as a control chart: attention where the last value or the last eight stand out. One row.

    Only whole months before the anchor are read. Months are few: one row for each is put in order.
    """
    series = monthly_trends(fs).where(F.col("month") < F.date_format(fs.anchor, "yyyy-MM"))
    order = Window.orderBy("month")
    moved = series.withColumn("range", F.abs(F.col("commits") - F.lag("commits").over(order))).withColumn("age", F.row_number().over(Window.orderBy(F.desc("month"))))
    mean = moved.agg(F.avg("commits").alias("mean"), F.avg("range").alias("moving_range"), F.max_by("commits", "month").alias("last"), F.count(F.lit(1)).alias("n"))
    joined = moved.join(F.broadcast(mean))
    sides = joined.where("age <= 8").agg(F.count_if(F.col("commits") > F.col("mean")).alias("above"), F.count_if(F.col("commits") < F.col("mean")).alias("below"))
    run = (F.col("above") == 8) | (F.col("below") == 8)
    out = F.abs(F.col("last") - F.col("mean")) > 2.66 * F.col("moving_range")
    return mean.join(F.broadcast(sides)).select("n", "last", F.round("mean", 6).alias("mean"), F.round("moving_range", 6).alias("moving_range"), ((F.col("n") >= 4) & (run | out)).alias("attention"))


def evidence_commits(fs: FactStore, n: int = 3) -> DataFrame:
    """The newest commits of every path, by time and then by order of landing: ``path``, ``rev``, ``pos``, ``subject``."""
    newest = Window.partitionBy("path").orderBy(F.desc("date"), "seq")
    ranked = fs.dated_changes.select("path", "rev", "date", "seq").withColumn("pos", F.row_number().over(newest)).where(F.col("pos") <= n)
    subject = fs.commits.select("rev", F.split(F.coalesce("message", F.lit("")), "\n")[0].alias("subject"))
    return ranked.join(subject, "rev").select("path", "rev", F.col("pos").cast("long").alias("pos"), "subject")


def new_code(fs: FactStore) -> DataFrame:
    """Paths born in the window, and paths only touched in it: ``path``, ``scope``, ``added``."""
    since = fs.anchor - F.expr(f"INTERVAL {fs.options.window_days} DAYS")
    seen = fs.dated_changes.where(F.col("date") <= fs.anchor).groupBy("path").agg(F.min("date").alias("born"), F.max("date").alias("last"), F.sum(F.when(F.col("date") >= since, F.col("loc_added")).otherwise(0)).alias("added"))
    recent = seen.where(F.col("last") >= since).join(fs.live_paths, "path", "left_semi")
    return recent.select("path", F.when(F.col("born") >= since, "born").otherwise("touched").alias("scope"), "added")


def delta_health(before: DataFrame, after: DataFrame) -> DataFrame:
    """Outcome of every function between two snapshots, and the share of good ones.

    Inputs: ``path``, ``base``, ``loc``, ``cyclomatic``. Risk is high from 71 lines or 11 branches, medium
    from 31 or 6. A function that enters high risk, or rises in it, is bad; one that leaves it is good.
    """

    def risk(loc: str, cyc: str):
        high = (F.col(loc) >= 71) | (F.col(cyc) >= 11)
        return F.when(high, 2).when((F.col(loc) >= 31) | (F.col(cyc) >= 6), 1).otherwise(0)

    def flat(df: DataFrame, mark: str) -> DataFrame:
        per = df.groupBy("path", "base").agg(F.max("loc").alias("loc"), F.max("cyclomatic").alias("cyclomatic"))
        return per.select("path", "base", risk("loc", "cyclomatic").alias(f"risk_{mark}"), F.col("loc").alias(f"loc_{mark}"))

    both = flat(before, "a").join(flat(after, "b"), ["path", "base"], "full")
    a, b = F.coalesce("risk_a", F.lit(0)), F.coalesce("risk_b", F.lit(0))
    outcome = F.when(b > a, "bad").when(b < a, "good").when(F.col("loc_a").isNull(), "new").when(F.col("loc_b").isNull(), "removed").otherwise("same")
    return both.select("path", "base", outcome.alias("outcome"), F.greatest(F.coalesce("loc_a", F.lit(0)), F.coalesce("loc_b", F.lit(0))).alias("weight"))


def delta_of_halves(fs: FactStore) -> DataFrame:
    """Delta health between the first half of every readable file and the whole: an example of two snapshots."""
    after = fs.functions.select("path", "base", "loc", "cyclomatic")
    early = fs.functions.where("start_line <= 4").select("path", "base", "loc", "cyclomatic")
    return delta_health(early, after).groupBy("outcome").agg(F.count(F.lit(1)).alias("functions"), F.sum("weight").alias("weight"))


def ai_classes(fs: FactStore) -> DataFrame:
    """How commits were written, read from identity and message: machine, assisted or human."""
    kind = attribution(F.col("author_name"), F.col("author_email"), F.col("message"))
    return fs.commits.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("commits"))


def scan_coverage(fs: FactStore) -> DataFrame:
    """How many live paths could be read: eligible, scored, lost, and whether the share is below nine tenths. One row."""
    joined = fs.live_paths.join(fs.files.select("path", F.lit(True).alias("read")), "path", "left")
    counted = joined.agg(F.count(F.lit(1)).alias("eligible"), F.count("read").alias("scored"))
    share = F.col("scored") / F.nullif("eligible", F.lit(0))
    return counted.select("eligible", "scored", (F.col("eligible") - F.col("scored")).alias("lost"), F.round(share, 6).alias("share"), F.coalesce(share < 0.9, F.lit(False)).alias("thin"))


def szz_candidates(fs: FactStore, max_files: int = 8, max_churn: int = 400, pattern: str = r"(?i)\b(fix|bug|defect)") -> DataFrame:
    """Commits that a fix implicates: ``fix_rev``, ``path``, ``bug_rev``.

    A fix names itself, touches at most eight paths and 400 lines, and only modifications that delete lines
    count. The last earlier region on the path that overlaps the fix's old side is implicated, however old it is.
    """
    by_rev = fs.replacing(changes=fs.table("changes").repartition("rev"))  # one exchange serves duplicates, sizes and joins
    sizes = by_rev.changes.groupBy("rev").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("loc_added") + F.col("loc_deleted")).alias("churn")).where((F.col("n") <= max_files) & (F.col("churn") <= max_churn))
    fixes = fs.commits.where(F.col("message").rlike(pattern)).join(sizes, "rev", "left_semi").select("rev", F.lit(True).alias("fix"))
    dated = fs.commits.select("rev", F.unix_micros("date").alias("at")).where("at is not null")
    h = by_rev.hunks.join(dated, "rev").join(fixes, "rev", "left").repartition("path")

    def lines(start: str, count: str, old: bool):
        return F.transform(F.sequence(F.lit(0), F.col(count).cast("int") - 1), lambda k: F.struct((F.col(start) + k).alias("line"), F.lit(old).alias("old")))

    # regions are a few lines long, so they meet line by line: each line of a fix takes the latest region before it
    fixed = F.when(F.col("fix") & (F.col("old_lines") > 0), lines("old_start", "old_lines", True)).otherwise(F.array())
    made = F.when(F.col("new_lines") > 0, lines("new_start", "new_lines", False)).otherwise(F.array())
    met = h.select("path", "rev", "at", F.explode(F.concat(made, fixed)).alias("l")).select("path", "rev", "at", "l.line", "l.old")
    earlier = Window.partitionBy("path", "line").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    latest = F.max(F.when(~F.col("old"), F.struct("at", "rev"))).over(earlier)
    hit = met.select("path", "rev", "old", latest.alias("hit")).where("old and hit is not null")
    return hit.groupBy(F.col("rev").alias("fix_rev"), "path").agg(F.max("hit")["rev"].alias("bug_rev"))


def defect_validation(fs: FactStore, names: Sequence[str] = ("auc", "precision_at_10")) -> DataFrame:
    """How well revision counts rank the paths that fixes implicate: ``metric``, ``value``."""
    from tidemark.functions.stats import precision_at, roc_auc

    bad = szz_candidates(fs).select("path").distinct().withColumn("bad", F.lit(True))
    scored = fs.changes.groupBy("path").agg(F.count(F.lit(1)).alias("score")).join(bad, "path", "left").withColumn("bad", F.coalesce("bad", F.lit(False)))
    scored = stage_table(scored)
    auc = roc_auc(scored, "score", "bad").select(F.lit(names[0]).alias("metric"), F.round("auc", 6).alias("value"))
    top = precision_at(scored, "score", "bad", "path", 10).select(F.lit(names[1]).alias("metric"), F.round("precision", 6).alias("value"))
    return auc.unionByName(top)
