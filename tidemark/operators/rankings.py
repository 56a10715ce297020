"""Rankings that combine history with the present state of the files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.stats import count_below, wilson_interval
from tidemark.operators import churn, coupling, ownership
from tidemark.operators.places import place_rows
from tidemark.session import stage_table
from tidemark.sources.facts import FactStore

#: Weights of the smells in structural risk.
SMELLS = {"complex-method": 0.22, "god-class": 0.18, "large-method": 0.12, "dry": 0.12, "shotgun": 0.12, "nesting": 0.10, "args": 0.07, "conditional": 0.07}
RED, YELLOW = 0.55, 0.28
COHORT = 10
CORPUS_METRICS = ("cyclomatic", "cognitive", "sloc", "nargs", "max_nesting")
LANGUAGE_SAMPLES = 500
OWNER_NOTE = "unhealthy code without an active owner tends to change more slowly; a correlation, not a cause"


def percent_ranked(df: DataFrame, value: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with the percent rank of a value; null where the value is null.

    Rows are counted per distinct value first, and values are ranked by :func:`count_below`, so that no task
    sorts all values of a hot group or of the whole.
    """
    by = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    rank = F.when(F.col("_total") > 1, F.col("_less") / (F.col("_total") - 1)).otherwise(F.lit(0.0))
    ranks = count_below(counts, value, "_n", by).select(*by, value, rank.alias(out))
    return df.join(ranks, [*by, value], "left")


def _clamped(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))


def hotspots(fs: FactStore) -> DataFrame:
    """Paths that change often and are complex.

    Ranks are taken over scanned files with enough revisions. Health falls with complexity relative to the
    most complex file; the score is the product of both ranks and the missing health.
    """
    revs = churn.revisions(fs, coupling.source_of(fs)).withColumnRenamed("n_revs", "revisions")
    scanned = revs.join(fs.files.select("path", "cognitive", F.round("mi", 9).alias("mi")), "path")
    ai = F.coalesce(F.col("ai_attribution").isin("ai-authored", "ai-assisted"), F.lit(False))
    by_ai = fs.dated_changes.groupBy("path").agg(F.count(F.lit(1)).alias("all"), F.count_if(ai).alias("ai"))
    ranked = percent_ranked(percent_ranked(percent_ranked(scanned, "revisions", "r_revs"), "cognitive", "r_cog"), "mi", "mi_rank")
    peak = scanned.agg(F.max("cognitive").alias("peak"))
    health = _clamped(100 * (1 - 0.4 * F.coalesce(F.col("cognitive") / F.nullif("peak", F.lit(0)), F.lit(0.0))))
    return (
        ranked.join(F.broadcast(peak))
        .join(by_ai, "path")
        .withColumn("health", health)
        .select(
            "path",
            "revisions",
            "cognitive",
            F.round("health", 6).alias("cognitive_health"),
            F.round(F.col("r_revs") * F.col("r_cog") * (100 - F.col("health")) / 4, 9).alias("hotspot_score"),
            F.round("mi", 6).alias("mi"),
            F.round("mi_rank", 9).alias("mi_rank"),
            F.round(100.0 * F.col("ai") / F.col("all"), 6).alias("ai_pct"),
        )
    )


def corpus_positions(fs: FactStore) -> DataFrame:
    """Where each file lies in the measured corpus of its language and size: ``path``, ``corpus_percentile``, ``samples`` of the language.

    Each stratum gives the middle rank of a metric's value among its quantiles; strata count by their samples.
    Each distinct value of a range of sizes is placed once among the quantiles of all its strata.
    The metric in which the file lies highest counts. Languages of fewer than 500 sample functions are left out.
    """
    sizes = fs.table("strata").select("artifact_id", "lang", "sloc_min", "sloc_max", "sample_functions", "metrics")
    trusted = sizes.drop("metrics").distinct().groupBy("lang").agg(F.sum("sample_functions").alias("samples")).where(F.col("samples") >= LANGUAGE_SAMPLES)
    strata = (
        sizes.withColumn("m", F.explode("metrics"))
        .drop("metrics")
        .where(F.col("m.metric").isin(*CORPUS_METRICS))
        .distinct()
        .select("lang", "sloc_min", "sloc_max", "sample_functions", "m.metric", F.filter("m.quantiles", lambda x: x.isNotNull() & ~F.isnan(x)).alias("q"))
        .where(F.size("q") > 0)
        .join(trusted.select("lang"), "lang")
    )
    strata = strata.select("lang", "metric", "sloc_min", "sloc_max", "sample_functions", "q")
    # strata of one range of sizes have one step function: the weight of what is less, by distinct value
    ranges = ["lang", "metric", "sloc_min", "sloc_max"]
    totals = strata.groupBy(*ranges).agg(F.sum("sample_functions").alias("weight"))
    steps = strata.select(*ranges, (F.coalesce("sample_functions", F.lit(0)) / F.size("q")).alias("w"), F.explode("q").alias("v"))
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in CORPUS_METRICS]))
    sized = fs.files.select("path", "lang", "sloc", values.alias("x")).select("path", "lang", "sloc", "x.metric", "x.v")
    kinds = sized.select("lang", "metric", "sloc", "v").distinct().alias("f")
    r = totals.alias("r")
    at = (F.col("f.lang") == F.col("r.lang")) & (F.col("f.metric") == F.col("r.metric")) & (F.col("f.sloc") >= F.col("r.sloc_min")) & (F.col("f.sloc") <= F.col("r.sloc_max"))
    met = kinds.join(r, at).select(*[f"r.{c}" for c in ranges], "f.sloc", "f.v", _finite(F.col("f.v")).alias("at"), "r.weight")
    asked = met.where("at is not null").select(*ranges, "at").distinct()
    events = steps.select(*ranges, _finite(F.col("v")).alias("at"), "w").unionByName(asked.withColumn("w", F.lit(0.0))).groupBy(*ranges, "at").agg(F.sum("w").alias("w"))
    below = count_below(events, "at", "w", ranges).select(*ranges, "at", ((F.col("_less") + F.col("w") / 2) / F.nullif("_total", F.lit(0.0))).alias("part"))
    # a missing value lies above nothing
    placed = met.join(below, [*ranges, "at"], "left").withColumn("part", F.coalesce("part", F.lit(0.0)))
    share = F.round(F.sum(F.col("part") * F.col("weight")) / F.nullif(F.sum("weight"), F.lit(0)), 9)
    per = placed.groupBy("lang", "metric", "sloc", "v").agg(share.alias("p")).join(trusted, "lang")
    found = sized.alias("f").join(per.alias("p"), (F.col("f.lang") == F.col("p.lang")) & (F.col("f.metric") == F.col("p.metric")) & (F.col("f.sloc") == F.col("p.sloc")) & F.col("f.v").eqNullSafe(F.col("p.v")))
    return found.groupBy("f.path").agg(F.max("p.p").alias("corpus_percentile"), F.max("p.samples").alias("samples"))


def _finite(value: Column) -> Column:
    """A value that can be put in a bucket of magnitude, in the order of the values; NaN is above all."""
    return F.when(F.isnan(value), F.lit(1.5e308)).when(value.isNotNull(), F.greatest(F.lit(-1e308), F.least(F.lit(1e308), value)))


def corpus_percentiles(fs: FactStore) -> DataFrame:
    """The corpus percentile of each file: ``path``, ``corpus_percentile``."""
    return corpus_positions(fs).select("path", "corpus_percentile")


def hotspots_anchored(fs: FactStore) -> DataFrame:
    """Hotspot score against the corpus: revisions ranked over all files, complexity by its corpus percentile."""
    revs = fs.changes.groupBy("path").agg(F.count(F.lit(1)).alias("revisions"))
    ranked = percent_ranked(revs, "revisions", "r").join(corpus_percentiles(fs), "path")
    t = F.col("corpus_percentile")
    return ranked.select("path", "revisions", "corpus_percentile", F.round(F.col("r") * t * (100 - _clamped(100 * (1 - 0.4 * t))) / 4, 9).alias("hotspot_score_anchored"))


def mi_bands(fs: FactStore) -> DataFrame:
    """Maintainability bands by rank over all readable files."""
    ranked = percent_ranked(fs.files.select("path", F.round("mi", 9).alias("mi")), "mi", "rank")
    return ranked.select("path", F.when(F.col("rank") >= 0.75, "high").when(F.col("rank") >= 0.25, "moderate").otherwise("low").alias("band"))


def fans(fs: FactStore) -> DataFrame:
    """Files that depend on each file, and the words it depends on."""
    into = fs.imports.where("resolved").groupBy(F.col("target_path").alias("path")).agg(F.count_distinct("src_path").alias("fan_in"))
    out = fs.imports.groupBy(F.col("src_path").alias("path")).agg(F.count_distinct("target").alias("fan_out"))
    return fs.files.select("path", "cognitive").join(into, "path", "left").join(out, "path", "left").na.fill(0, ["fan_in", "fan_out"])


def god_classes(fs: FactStore, min_cognitive: int = 30, min_fans: int = 10) -> DataFrame:
    """Complex files that many depend on and that depend on many."""
    both = F.col("fan_in") + F.col("fan_out")
    return fans(fs).where((F.col("cognitive") >= min_cognitive) & (both >= min_fans)).withColumn("god_score", F.col("cognitive") / 100 * both)


def clones(fs: FactStore) -> DataFrame:
    """Members of duplicated fragments with the size of their family."""
    return fs.clones.select("fingerprint", F.col("path").alias("entity"), "start_line", "end_line", "node_count", F.lit(1.0).alias("similarity"), "family_size")


def head_clone_counts(fs: FactStore) -> DataFrame:
    """Duplicated fragments per path."""
    return fs.clones.groupBy("path").agg(F.count(F.lit(1)).alias("clones"))


def biomarkers(fs: FactStore, clones: bool = True) -> DataFrame:
    """Intensity of every smell of every readable file in a language of at least ten files: ``path``, ``lang``, ``smell``, ``intensity``.

    Most smells are percent ranks within the language. God class and duplication count only where present;
    shotgun surgery ranks the coupled paths of all languages together. Duplication is left out without ``clones``.
    """
    sized = fs.files
    cohort = sized.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COHORT).select("lang")
    large = fs.functions.groupBy("path").agg(F.max("loc").alias("large"))
    god = fans(fs).select("path", (F.col("cognitive") * (F.col("fan_in") + F.col("fan_out"))).alias("god"))
    # what is ranked is read many times, so it is stored
    base = stage_table(
        sized.join(cohort, "lang")
        .join(large, "path", "left")
        .join(head_clone_counts(fs) if clones else large.select("path", F.lit(0).alias("clones")), "path", "left")
        .join(god, "path", "left")
        .select("path", "lang", "cognitive", F.coalesce("large", F.lit(0)).alias("large"), F.coalesce("clones", F.lit(0)).alias("dry"), F.coalesce("god", F.lit(0)).alias("god"), "max_nesting", "nargs", "bool_ops")
    )
    columns = {"complex-method": "cognitive", "god-class": "god", "large-method": "large", "dry": "dry", "nesting": "max_nesting", "args": "nargs", "conditional": "bool_ops"}
    if not clones:
        del columns["dry"]
    pairs = F.array(*[F.struct(F.lit(s).alias("smell"), F.col(c).cast("long").alias("value")) for s, c in columns.items()])
    long = base.select("path", "lang", F.explode(pairs).alias("p")).select("path", "lang", "p.smell", "p.value")
    ranked = percent_ranked(long, "value", "rank", by=["lang", "smell"])
    present = F.when(F.col("smell").isin("god-class", "dry") & (F.col("value") <= 0), 0.0).otherwise(F.col("rank"))
    degree = stage_table(coupling.partner_index(coupling.coupling(fs)).groupBy("path").agg(F.count(F.lit(1)).alias("value")))
    shotgun = percent_ranked(degree, "value", "rank").join(base.select("path", "lang"), "path").select("path", "lang", F.lit("shotgun").alias("smell"), F.col("rank").alias("intensity"))
    return ranked.select("path", "lang", "smell", present.alias("intensity")).unionByName(shotgun)


def biomarker_table(fs: FactStore) -> DataFrame:
    """Biomarkers rounded for reporting."""
    return biomarkers(fs).withColumn("intensity", F.round("intensity", 9))


def structural_risk(fs: FactStore, clones: bool = True) -> DataFrame:
    """``path``, ``lang``, ``structural_risk``, ``dominant_type`` from the biomarkers; without ``clones`` the other weights count as the whole."""
    weight = F.coalesce(*[F.when(F.col("smell") == s, F.lit(w)) for s, w in SMELLS.items()])
    strongest = F.min_by("smell", F.struct((-F.round("intensity", 9)).alias("k"), "smell"))
    whole = 1.0 if clones else round(1 - SMELLS["dry"], 9)
    total = biomarkers(fs, clones).groupBy("path", "lang").agg(
        F.round(F.least(F.lit(1.0), F.sum(F.col("intensity") * weight) / whole), 9).alias("structural_risk"), strongest.alias("top"), F.max("intensity").alias("peak")
    )
    return total.select("path", "lang", "structural_risk", F.when(F.col("peak") > 0, F.col("top")).otherwise("none").alias("dominant_type"))


def band_of(risk: Column) -> Column:
    """Red, yellow or green by structural risk."""
    return F.when(risk >= RED, "red").when(risk >= YELLOW, "yellow").otherwise("green")


def code_health(fs: FactStore, clones: bool = True) -> DataFrame:
    """Health of every readable file: structure, churn and ownership together, with band and cohort percentile.

    The corpus percentile with its bounds is null for a language or size that the corpus does not know.
    """
    risk = stage_table(structural_risk(fs, clones))
    scored = health_scores(fs, risk)
    return percent_ranked(scored, "structural_risk", "percentile", by=["lang"]).join(corpus_lens(fs), "path", "left").select(
        "path", "lang", "cognitive", "score", "structural_risk", F.round("percentile", 9).alias("percentile"), band_of(F.col("structural_risk")).alias("band"), "dominant_type",
        "corpus_percentile", "beyond_corpus", "ci_low", "ci_high",
    )


def health_scores(fs: FactStore, risk: DataFrame) -> DataFrame:
    """Structural risk with the score alone: without ranks, and without the corpus, which no score depends on."""
    lines = fs.changes.groupBy("path").agg(F.sum(F.col("loc_added") + F.col("loc_deleted")).alias("churn"))
    scattered = ownership.ownership(fs.with_options(min_revs=1)).select("path", "fractal_value")
    joined = risk.join(fs.files.select("path", "cognitive"), "path").join(lines, "path", "left").join(scattered, "path", "left")
    joined = joined.na.fill(0, ["churn"]).na.fill(0.0, ["fractal_value"])
    peak = lines.join(risk.select("path"), "path", "left_semi").agg(F.max("churn").alias("peak"))
    share = F.coalesce(F.col("churn") / F.nullif("peak", F.lit(0)), F.lit(0.0))
    score = _clamped(100 * (1 - 0.5 * F.col("structural_risk") - 0.3 * share - 0.2 * F.col("fractal_value")))
    return joined.join(F.broadcast(peak)).select("path", "lang", "cognitive", F.round(score, 6).alias("score"), "structural_risk", "dominant_type")


def corpus_lens(fs: FactStore) -> DataFrame:
    """Code health seen against the corpus: percentile with its bounds, and whether it lies beyond the corpus' last percent."""
    low, high = wilson_interval(F.col("corpus_percentile") * F.col("samples"), F.col("samples"))
    return corpus_positions(fs).select("path", "corpus_percentile", (F.col("corpus_percentile") >= 0.99).alias("beyond_corpus"), F.round(low, 9).alias("ci_low"), F.round(high, 9).alias("ci_high"))


def refactoring_targets(fs: FactStore) -> DataFrame:
    """Where refactoring pays: risk and hotspot score per line."""
    hot = hotspots(fs).select("path", "hotspot_score", "revisions")
    health = structural_risk(fs)
    joined = health.join(hot, "path").join(fs.files.select("path", "loc"), "path")
    ranked = joined.withColumn("priority", F.round(F.col("structural_risk") * F.col("hotspot_score") / F.greatest(F.col("loc"), F.lit(25)), 9))
    combined = F.round(F.col("structural_risk") * F.col("hotspot_score"), 9).alias("combined_risk")
    # the place a reader gets who works upwards from the smallest file
    placed = place_rows(ranked.withColumn("combined_risk", combined), F.col("loc"), F.col("path")).withColumnRenamed("place", "manual_up_rank")
    return placed.select("path", "priority", "combined_risk", "structural_risk", "hotspot_score", "revisions", "loc", "dominant_type", band_of(F.col("structural_risk")).alias("band"), "manual_up_rank")


def function_hotspots(fs: FactStore) -> DataFrame:
    """Functions that change often and are complex; the score is that of hotspots."""
    revs = coupling.touched_functions(fs).groupBy("path", "name").agg(F.count(F.lit(1)).alias("revs")).where(F.col("revs") >= fs.options.min_revs)
    scored = revs.join(fs.functions.select("path", "name", "cognitive"), ["path", "name"])
    ranked = percent_ranked(percent_ranked(scored, "revs", "r_revs"), "cognitive", "r_cog")
    peak = scored.agg(F.max("cognitive").alias("peak"))
    health = _clamped(100 * (1 - 0.4 * F.coalesce(F.col("cognitive") / F.nullif("peak", F.lit(0)), F.lit(0.0))))
    return (
        ranked.join(F.broadcast(peak))
        .withColumn("h", health)
        .select(
            "path",
            F.col("name").alias("function"),
            "revs",
            "cognitive",
            F.round("h", 6).alias("cognitive_health"),
            F.round(F.col("r_revs") * F.col("r_cog") * (100 - F.col("h")) / 4, 9).alias("function_hotspot_score"),
        )
    )


def function_xray(fs: FactStore) -> DataFrame:
    """Every function of one file with how often and when it last changed; untouched ones stay."""
    target = fs.options.target
    hits = coupling.touched_functions(fs, target).join(fs.commits.select("rev", "date"), "rev").groupBy("name").agg(F.count(F.lit(1)).alias("change_freq"), F.max("date").alias("last_at"))
    return (
        fs.functions.where(F.col("path") == target)
        .join(hits, "name", "left")
        .select(F.col("name").alias("function"), F.coalesce("change_freq", F.lit(0)).alias("change_freq"), "loc", "cyclomatic", "cognitive", F.date_format("last_at", "yyyy-MM-dd").alias("last_changed"))
    )


def delivery_friction(fs: FactStore) -> DataFrame:
    """Paths that change often, land late and are complex."""
    late = (F.unix_micros("committer_date") - F.unix_micros("date")) / F.lit(1e6)
    lead = F.when(late > 0, late)
    per = fs.dated_changes.groupBy("path").agg(
        F.count(F.lit(1)).alias("revisions"),
        (F.percentile(lead, F.lit(0.5)) / 86400).alias("median_lead"),
        (F.percentile(lead, F.lit(0.95)) / 86400).alias("p95_lead"),
        F.max("committer_date").alias("last_landed"),
    )
    kept = per.where(F.col("revisions") >= fs.options.min_revs).join(fs.files.select("path", "cognitive"), "path", "left").withColumn("cognitive", F.coalesce("cognitive", F.lit(0)))
    ranked = percent_ranked(percent_ranked(percent_ranked(kept, "revisions", "r_revs"), "median_lead", "r_lead"), "cognitive", "r_cog")
    return ranked.select(
        "path",
        "revisions",
        "cognitive",
        F.round("median_lead", 6).alias("median_lead_time_days"),
        F.round("p95_lead", 6).alias("p95_lead_time_days"),
        F.datediff(fs.anchor, "last_landed").cast("long").alias("wip_age_days"),
        F.round(F.coalesce(F.col("r_revs") * F.col("r_lead") * F.col("r_cog") * 100, F.lit(0.0)), 9).alias("friction_score"),
    )


def effort_exposure(fs: FactStore) -> DataFrame:
    """How much of the code, the commits and the churn of the window falls on each health band, with 95 % bounds of the commit share."""
    banded = structural_risk(fs).select("path", band_of(F.col("structural_risk")).alias("band")).join(fs.files.select("path", "sloc"), "path")
    since = fs.anchor - F.expr(f"INTERVAL {fs.options.window_days} DAYS")
    recent = fs.dated_changes.where((F.col("date") >= since) & (F.col("date") <= fs.anchor)).join(banded, "path")
    by_band = recent.groupBy("band").agg(F.count_distinct("rev").alias("commits"), F.sum(F.col("loc_added") + F.col("loc_deleted")).alias("churn"))
    code = banded.groupBy("band").agg(F.count(F.lit(1)).alias("files"), F.sum("sloc").alias("sloc"))
    joined = code.join(by_band, "band", "left").na.fill(0, ["commits", "churn"])
    totals = recent.agg(F.count_distinct("rev").alias("all_commits"))
    # three bands: sums over them are sums over three rows
    everything = Window.partitionBy(F.lit(0))
    low, high = wilson_interval(F.col("commits"), F.col("all_commits"))

    def pct(part: str, whole: Column) -> Column:
        return F.round(100.0 * F.col(part) / F.nullif(whole, F.lit(0)), 6)

    return joined.join(F.broadcast(totals)).select(
        "band",
        "files",
        pct("sloc", F.sum("sloc").over(everything)).alias("loc_share_pct"),
        pct("commits", F.col("all_commits")).alias("commit_share_pct"),
        pct("churn", F.sum("churn").over(everything)).alias("churn_share_pct"),
        F.round(100 * low, 6).alias("ci_low"),
        F.round(100 * high, 6).alias("ci_high"),
    )


def coordination_needs(fs: FactStore) -> DataFrame:
    """How much coordination each path needs: who is active on it, how split its knowledge is, how authors alternate.

    Alternation compares each commit with the one before it on the path. The entropy is that of the path's
    co-change partners over the window's moderate commits, weighted by their degree.
    """
    shares = ownership.knowledge_shares(fs).groupBy("path").agg(F.sum(F.col("k_norm") * F.col("k_norm")).alias("squares"))
    since = fs.anchor - F.expr(f"INTERVAL {fs.options.window_days} DAYS")
    order = Window.partitionBy("path").orderBy("date", F.desc("seq"))
    turns = fs.dated_changes.withColumn("before", F.lag("canonical_author").over(order))
    per = turns.groupBy("path").agg(
        F.count(F.lit(1)).alias("total_commits"),
        F.count_if(F.col("before").isNotNull() & (F.col("before") != F.col("canonical_author"))).alias("switches"),
        F.count_distinct(F.when((F.col("date") >= since) & (F.col("date") <= fs.anchor), F.col("canonical_author"))).alias("authors"),
    )
    frag = F.round(F.coalesce(1 - F.col("squares"), F.lit(0.0)), 9)
    inter = F.round(F.when(F.col("total_commits") > 1, F.col("switches") / (F.col("total_commits") - 1)).otherwise(0.0), 9)
    tier = (
        F.when(F.col("authors") <= 1, "single")
        .when(F.col("fragmentation") < 0.25, "low")
        .when((F.col("fragmentation") >= 0.5) & (F.col("interleave") >= 0.5), "high")
        .otherwise("medium")
    )
    return (
        per.join(fs.live_paths, "path", "left_semi")
        .join(shares, "path", "left")
        .withColumn("fragmentation", frag)
        .withColumn("interleave", inter)
        .join(cochange_entropy(fs), "path", "left")
        .join(structural_risk(fs).select("path", band_of(F.col("structural_risk")).alias("health_band")), "path", "left")
        .select("path", "authors", "fragmentation", "interleave", F.coalesce("cochange_entropy", F.lit(0.0)).alias("cochange_entropy"), tier.alias("tier"), "health_band", "total_commits")
    )


def cochange_entropy(fs: FactStore) -> DataFrame:
    """Entropy of each path's co-change within the window, by its share of all co-change: ``path``, ``cochange_entropy``."""
    since = fs.anchor - F.expr(f"INTERVAL {fs.options.window_days} DAYS")
    recent = fs.dated_changes.where((F.col("date") >= since) & (F.col("date") <= fs.anchor)).select("rev", "path")
    good = churn.good_commits(fs, recent)
    # a path's degree is the number of others it changed along with, over all commits
    degree = recent.join(good, "rev").groupBy("path").agg(F.sum(F.col("n_files") - 1).alias("degree")).where("degree > 0")
    total = degree.agg(F.sum("degree").alias("total"))
    p = F.col("degree") / F.col("total")
    return degree.join(F.broadcast(total)).select("path", F.round(-p * F.log2(p), 9).alias("cochange_entropy"))


def marginal_owner_risk(fs: FactStore) -> DataFrame:
    """Unhealthy files that hardly anyone active knows."""
    banded = structural_risk(fs).select("path", band_of(F.col("structural_risk")).alias("band")).where("band <> 'green'")
    joined = banded.join(ownership.top_active_share(fs), "path", "left").withColumn("top_active_share", F.coalesce("top_active_share", F.lit(0.0)))
    share = F.col("top_active_share")
    risk = F.when((F.col("band") == "red") & (share < 0.1), "high").when(((F.col("band") == "red") & (share < 0.3)) | ((F.col("band") == "yellow") & (share < 0.1)), "elevated")
    return joined.withColumn("risk", risk).where("risk is not null").withColumn("note", F.lit(OWNER_NOTE))


def todo_findings(fs: FactStore) -> DataFrame:
    """Findings in the code itself: open tasks, as an external scanner would report them."""
    return fs.lines.where(F.col("line").contains("TODO")).select(
        F.lit("todo-scan").alias("engine"), F.lit("1").alias("engine_version"), F.lit("open-task").alias("rule_id"), "path", F.col("at").alias("start_line"), F.col("at").alias("end_line"), F.lit("warning").alias("level")
    )


def finding_hotspot_overlap(fs: FactStore, findings: DataFrame | None = None) -> DataFrame:
    """Findings on files, ranked by how often the files change and how healthy they are. No findings at all are an error."""
    found = todo_findings(fs) if findings is None else findings
    if not found.take(1):
        raise ValueError("there are no findings; read a scanner's report first")
    rank = F.coalesce(*[F.when(F.col("level") == name, F.lit(k)) for k, name in enumerate(("note", "warning", "error"))], F.lit(0))
    per = found.groupBy("path").agg(F.count(F.lit(1)).alias("findings"), F.count_distinct("engine").alias("engines"), F.max_by("level", rank).alias("worst_level"))
    revs = percent_ranked(fs.changes.groupBy("path").agg(F.count(F.lit(1)).alias("revs")), "revs", "revs_percentile")
    banded = structural_risk(fs).select("path", band_of(F.col("structural_risk")).alias("health_band"))
    hot = hotspots(fs).select("path", "hotspot_score")
    joined = per.join(revs, "path", "left").join(banded, "path", "left").join(hot, "path", "left").withColumn("revs_percentile", F.round(F.coalesce("revs_percentile", F.lit(0.0)), 9))
    red = F.col("health_band") == "red"
    priority = F.when((F.col("revs_percentile") >= 0.9) & red, "act-now").when((F.col("revs_percentile") >= 0.7) | red, "plan").otherwise("note")
    return joined.select("path", "findings", "engines", "worst_level", "hotspot_score", "revs_percentile", "health_band", priority.alias("priority"))
