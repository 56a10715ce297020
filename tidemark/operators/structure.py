"""The dependency graph of the files and what it says together with history."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.stats import count_below
from tidemark.operators import churn, coupling, rankings
from tidemark.operators.hierarchy import resolve_hierarchy
from tidemark.operators.relations import sampled_commits
from tidemark.session import drop_staged, settled, stage_table
from tidemark.sources.facts import FactStore

SAMPLES = 12


def closure(edges: DataFrame) -> DataFrame:
    """Pairs ``src``, ``dst`` with a way from one to the other, by frontier expansion.

    Each round extends only the pairs found in the last one and drops known ones, until none is new; rounds
    equal the longest shortest way. The result is as large as reachability itself, which the analyses need in
    full.
    """
    steps = stage_table(edges.select(F.col(edges.columns[0]).alias("src"), F.col(edges.columns[1]).alias("dst")).where("src is not null and dst is not null").distinct())
    parts, frontier = [steps], steps
    onward = steps.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
    while True:
        known = reduce(DataFrame.unionByName, parts)
        frontier = stage_table(frontier.join(onward, "dst").select("src", F.col("next").alias("dst")).distinct().join(known, ["src", "dst"], "left_anti"))
        if not frontier.take(1):
            break
        parts.append(frontier)
    return reduce(DataFrame.unionByName, parts)


def reach(fs: FactStore) -> DataFrame:
    """Reachability over the resolved dependencies."""
    return fs.once("reach", lambda: closure(fs.import_edges))


def components(reached: DataFrame) -> DataFrame:
    """Members of cycles: ``path``, ``component`` (the least member)."""
    back = reached.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    mutual = reached.join(back, ["src", "dst"])
    return mutual.groupBy(F.col("src").alias("path")).agg(F.least(F.min("dst"), F.first("src")).alias("component"))


def cycle_members(fs: FactStore) -> DataFrame:
    """Members of cycles of at least two files."""
    return components(reach(fs))


def dependency_cycles(fs: FactStore) -> DataFrame:
    """Cycles by size and first path: ``cycle_id``, ``size``, ``path``. Cycles are few beside files."""
    members = cycle_members(fs)
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where("size >= 2")
    numbered = sizes.withColumn("cycle_id", F.row_number().over(Window.orderBy(F.desc("size"), "component")).cast("long"))
    return members.join(numbered, "component").select("cycle_id", "size", "path")


def visibility(fs: FactStore) -> DataFrame:
    """How many files reach each file and are reached from it, itself included, and its cycle."""
    r = reach(fs).where("src <> dst")
    into = r.groupBy(F.col("dst").alias("path")).agg(F.count(F.lit(1)).alias("vfi"))
    out = r.groupBy(F.col("src").alias("path")).agg(F.count(F.lit(1)).alias("vfo"))
    nodes = fs.files.select("path")
    joined = nodes.join(into, "path", "left").join(out, "path", "left").join(cycle_members(fs), "path", "left")
    return joined.select("path", (F.coalesce("vfi", F.lit(0)) + 1).alias("vfi"), (F.coalesce("vfo", F.lit(0)) + 1).alias("vfo"), "component")


def architecture_roles(fs: FactStore) -> DataFrame:
    """The role of each file: core, shared, control or periphery.

    The core is the largest cycle (the first path decides between equals); without a cycle the upper medians
    of both visibilities take its place. ``level`` is the longest way down to a file that depends on nothing.
    """
    v = stage_table(visibility(fs).join(dependency_levels(fs), "path"))
    largest = v.where("component is not null").groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.max("vfi").alias("core_vfi"), F.max("vfo").alias("core_vfo"))
    core = largest.orderBy(F.desc("n"), "component").limit(1)
    total = v.agg(F.count(F.lit(1)).alias("files"))
    def upper_median(value: str) -> DataFrame:
        per = count_below(v.groupBy(value).agg(F.count(F.lit(1)).alias("n")), value, "n")
        return per.where(F.floor(F.col("_total") / 2) < F.col("_less") + F.col("n")).agg(F.min(value).alias(f"m_{value}"))

    upper = upper_median("vfi").join(F.broadcast(upper_median("vfo")))  # one row each
    refs = total.join(F.broadcast(upper)).join(F.broadcast(core.withColumnRenamed("component", "core_id")), F.lit(True), "left")
    wide_in = F.col("vfi") >= F.coalesce(F.col("core_vfi").cast("double"), F.col("m_vfi"))
    wide_out = F.col("vfo") >= F.coalesce(F.col("core_vfo").cast("double"), F.col("m_vfo"))
    role = F.when(F.col("component") == F.col("core_id"), "core").when(wide_in & ~wide_out, "shared").when(~wide_in & wide_out, "control").otherwise("periphery")
    return v.join(F.broadcast(refs)).select("path", role.alias("role"), "vfi", "vfo", F.col("component").isNotNull().alias("in_cycle"), "level", F.round(100.0 * F.col("vfo") / F.col("files"), 6).alias("reach_pct"))


def dependency_levels(fs: FactStore) -> DataFrame:
    """Layers of the condensed graph: ``path``, ``level``; 0 depends on nothing outside its cycle."""
    comp = fs.files.select("path").join(cycle_members(fs), "path", "left").select("path", F.coalesce("component", "path").alias("node"))
    comp = stage_table(comp)
    a, b = comp.select(F.col("path").alias("src_path"), F.col("node").alias("src")), comp.select(F.col("path").alias("target_path"), F.col("node").alias("dst"))
    edges = stage_table(fs.import_edges.join(a, "src_path").join(b, "target_path").where("src <> dst").select("src", "dst").distinct())
    # nodes at the end of a chain of k edges, for growing k; the last k that a node has is its level
    layer = stage_table(edges.select(F.col("src").alias("node")).distinct())
    found = [layer.withColumn("level", F.lit(1))]
    for k in count(2):  # the condensed graph has no cycle, so chains end
        layer = stage_table(edges.join(layer.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node")).distinct())
        if not layer.take(1):
            break
        found.append(layer.withColumn("level", F.lit(k)))
    levels = reduce(DataFrame.unionByName, found).groupBy("node").agg(F.max("level").alias("level"))
    return comp.join(levels, "node", "left").select("path", F.coalesce("level", F.lit(0)).cast("long").alias("level"))


def instability(fs: FactStore) -> DataFrame:
    """Incoming and outgoing dependencies of every file, and the outgoing share."""
    e = fs.import_edges
    into = e.groupBy(F.col("target_path").alias("path")).agg(F.count(F.lit(1)).alias("ca"))
    out = e.groupBy(F.col("src_path").alias("path")).agg(F.count(F.lit(1)).alias("ce"))
    both = fs.files.select("path").join(into, "path", "left").join(out, "path", "left").na.fill(0, ["ca", "ce"])
    return both.withColumn("instability", F.coalesce(F.round(F.col("ce") / F.nullif(F.col("ca") + F.col("ce"), F.lit(0)), 9), F.lit(0.0)))


def architecture_metrics(fs: FactStore) -> DataFrame:
    """Measures of the whole graph: ``metric``, ``value``."""
    v = stage_table(visibility(fs))
    size = v.agg(F.count(F.lit(1)).alias("n"), F.sum("vfo").alias("ccd"), F.count("component").alias("cyclic"))
    cycles = v.where("component is not null").groupBy("component").agg(F.count(F.lit(1)).alias("k")).agg(F.count(F.lit(1)).alias("cycles"), F.coalesce(F.max("k"), F.lit(0)).alias("largest"))
    imported = fs.imports.agg(F.count(F.lit(1)).alias("imports"), F.count_if("resolved").alias("resolved"))
    n = F.col("n").cast("double")
    kind = F.when(F.col("cycles") == 0, "hierarchical").when(F.col("largest") >= 0.6 * F.col("cyclic"), "core-periphery").otherwise("multi-core")

    def text(value: Column) -> Column:
        return F.format_string("%.4f", value.cast("double"))

    metrics = {
        "files": F.col("n").cast("string"),
        "propagation_cost": text(F.round(F.col("ccd") / (n * n), 4)),
        "average_dependency": text(F.round(F.col("ccd") / n, 4)),
        "normalised_dependency": text(F.round(F.col("ccd") / ((n + 1) * F.log2(n + 1) - n), 4)),
        "cycles": F.col("cycles").cast("string"),
        "largest_cycle": F.col("largest").cast("string"),
        "type": kind,
        "import_resolution": text(F.round(F.col("resolved") / F.nullif(F.col("imports"), F.lit(0)), 4)),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in metrics.items()])
    return size.join(F.broadcast(cycles)).join(F.broadcast(imported)).select(F.explode(pairs).alias("m")).select("m.metric", "m.value")


def lifetimes(fs: FactStore) -> DataFrame:
    """Times a path was alive: ``path``, ``since``, ``until`` (exclusive, null if it still is). They are those of ``live_at``."""
    along = Window.partitionBy("path").orderBy("date", F.desc("seq"))
    states = fs.dated_changes.where("date is not null").select("path", "change_type", F.col("date").alias("since"), F.lead("date").over(along).alias("until"))
    return states.where("change_type <> 'deleted' and (until is null or until > since)").select("path", "since", "until")


def sampled_graphs(fs: FactStore, samples: int = SAMPLES) -> DataFrame:
    """The graph between the paths alive at evenly spaced commits: ``k``, ``rev``, ``date``, ``files``, ``pairs``, ``cycle_count``, ``largest_cycle``, ``cyclic``.

    Nodes are pairs of sample and path, so that one closure serves all samples; its rounds equal the longest
    shortest way of any.
    """
    moments = stage_table(sampled_commits(fs, samples).select("k", "rev", "date"))
    # at most `samples` rows
    inside = (F.col("since") <= F.col("date")) & (F.col("until").isNull() | (F.col("until") > F.col("date")))
    alive = stage_table(lifetimes(fs).join(fs.files.select("path"), "path", "left_semi").join(F.broadcast(moments.select("k", "date")), inside).select("k", "path"))
    edges = fs.import_edges.join(alive.withColumnRenamed("path", "src_path"), "src_path").join(alive.withColumnRenamed("path", "target_path"), ["k", "target_path"])
    reached = closure(edges.select(F.struct("k", F.col("src_path").alias("path")).alias("src"), F.struct("k", F.col("target_path").alias("path")).alias("dst")))
    files = alive.groupBy("k").agg(F.count(F.lit(1)).alias("files"))
    pairs = reached.where("src <> dst").groupBy(F.col("src.k").alias("k")).agg(F.count(F.lit(1)).alias("pairs"))
    sizes = components(reached).groupBy("component").agg(F.count(F.lit(1)).alias("size")).where("size >= 2")
    cycles = sizes.groupBy(F.col("component.k").alias("k")).agg(F.count(F.lit(1)).alias("cycle_count"), F.max("size").alias("largest_cycle"), F.sum("size").alias("cyclic"))
    return moments.join(files, "k", "left").join(pairs, "k", "left").join(cycles, "k", "left").na.fill(0, ["files", "pairs", "cycle_count", "largest_cycle", "cyclic"])


def architecture_trend(fs: FactStore, samples: int = SAMPLES) -> DataFrame:
    """Files, propagation cost and cycles at evenly spaced commits: dependencies between the paths then alive."""
    return sampled_graphs(fs, samples).select("k", "rev", F.date_format("date", "yyyy-MM-dd").alias("date"), "files", F.round(_propagation_cost(), 9).alias("propagation_cost"), "cycle_count", "largest_cycle")


def _propagation_cost() -> Column:
    return F.coalesce((F.col("pairs") + F.col("files")) / F.nullif(F.col("files").cast("double") * F.col("files"), F.lit(0.0)), F.lit(0.0))


def health_band(health: str) -> Column:
    return F.when(F.col(health) >= 70, "green").when(F.col(health) >= 40, "yellow").otherwise("red")


def architecture_health(fs: FactStore, samples: int = SAMPLES) -> DataFrame:
    """Health of the graph and its band at the sampled commits: propagation cost, share in cycles, share in the largest one."""
    n = F.nullif(F.col("files"), F.lit(0))
    tangled = 0.3 * F.col("cyclic") / n + 0.2 * F.col("largest_cycle") / n
    health = 100 * (1 - F.least(F.lit(1.0), 0.5 * _propagation_cost() + F.coalesce(tangled, F.lit(0.0))))
    return sampled_graphs(fs, samples).select("k", "rev", "date", "files", F.round(health, 6).alias("arch_health")).withColumn("band", health_band("arch_health"))


def health_trend(fs: FactStore, samples: int = SAMPLES) -> DataFrame:
    """Health of architecture and code, their mean, and the bands at the sampled commits; ``band`` is the architecture's.

    Code health is the mean over the files alive at the commit, by the history up to it and without
    duplication; 100 if none is scored.
    """
    from tidemark.operators.snapshots import store_at

    t = stage_table(architecture_health(fs, samples))
    moments = t.select("k", F.date_format("date", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at")).orderBy("k").collect()

    def scored_at(m: Row) -> DataFrame:
        then = store_at(fs, m["at"])
        # stored inputs keep the plan, which reads them many times, small
        then = then.replacing(commits=stage_table(then.table("commits")), changes=stage_table(then.table("changes")), blobs=stage_table(then.table("blobs")))
        score = F.coalesce(F.round(F.avg("score"), 6), F.lit(100.0)).alias("code_health")
        scores = rankings.health_scores(then, stage_table(rankings.structural_risk(then, clones=False)))
        result = stage_table(scores.agg(F.lit(m["k"]).cast("long").alias("k"), score))
        then.close()
        return result

    # a sample leaves its one row
    scored = [settled(scored_at)(m) for m in moments]
    if not scored:
        return t.select("k", "rev", "files", "arch_health", "band", *[F.lit(None).cast(kind).alias(c) for c, kind in (("code_health", "double"), ("combined_health", "double"), ("code_band", "string"), ("combined_band", "string"))])
    both = t.join(reduce(DataFrame.unionByName, scored), "k").withColumn("combined_health", F.round(0.5 * F.col("arch_health") + 0.5 * F.col("code_health"), 6))
    return both.select("k", "rev", "files", "arch_health", "band", "code_health", "combined_health", health_band("code_health").alias("code_band"), health_band("combined_health").alias("combined_band"))


def cycle_origins(fs: FactStore, top: int = 10) -> DataFrame:
    """For the largest cycles: the first of all commits at which all members were in one cycle, and its place ``k`` in time.

    A way between two members never leaves their cycle, and dependencies are those of the present files, so
    the members are in one cycle exactly while all of them are alive.
    """
    members = stage_table(dependency_cycles(fs).where(F.col("cycle_id") <= top))
    alive = lifetimes(fs).join(members, "path")
    events = F.explode(F.array(F.struct(F.col("since").alias("date"), F.lit(1).alias("step")), F.struct(F.col("until").alias("date"), F.lit(-1).alias("step"))))
    steps = alive.select("cycle_id", "size", events.alias("e")).where("e.date is not null").groupBy("cycle_id", "size", F.col("e.date").alias("date")).agg(F.sum("e.step").alias("step")).where("step <> 0")
    counted = steps.withColumn("alive", F.sum("step").over(Window.partitionBy("cycle_id").orderBy("date")))
    formed = stage_table(counted.where("alive = size").groupBy("cycle_id", "size").agg(F.min("date").alias("formed")))
    # at most `top` rows
    upto = fs.commits.select("rev", "date", "seq").join(F.broadcast(formed), F.col("date") <= F.col("formed"))
    now = F.col("date") == F.col("formed")
    return upto.groupBy("cycle_id", "size").agg(F.count_if(~now).alias("k"), F.max_by(F.when(now, F.col("rev")), F.when(now, F.col("seq"))).alias("formed_at_rev"))


TRIED_SIZE = 64


def _cyclic_sizes(ways: dict[str, set[str]], without: str) -> list[int]:
    """Sizes of the cycles that are left without one file, largest first."""
    nodes = [n for n in ways if n != without]
    reach = {n: {m for m in ways[n] if m != without} for n in nodes}
    for middle in nodes:
        for n in nodes:
            if middle in reach[n]:
                reach[n] |= reach[middle]
    left, sizes = set(nodes), []
    for n in nodes:
        if n in left:
            own = {m for m in reach[n] if n in reach[m]} | {n}
            left -= own
            if len(own) > 1:
                sizes.append(len(own))
    return sorted(sizes, reverse=True)


def _extraction(edges):
    """The member of one small cycle whose removal leaves least of it."""
    import pandas as pd

    ways: dict[str, set[str]] = {}
    for a, b in zip(edges["src_path"], edges["target_path"], strict=True):
        ways.setdefault(a, set()).add(b)
        ways.setdefault(b, set())
    left = {n: _cyclic_sizes(ways, n) for n in ways}
    best = min(ways, key=lambda n: (left[n][0] if left[n] else 0, sum(left[n]), n))
    return pd.DataFrame({"cycle_id": [int(edges["cycle_id"].iloc[0])], "tried": [best]})


def cycle_health(fs: FactStore) -> DataFrame:
    """Heat of every cycle: its members' share of the window's churn, and the member whose extraction dismantles it best.

    Of a cycle of at most 64 files each member is taken out on trial: the one that leaves the smallest largest
    cycle, then the fewest files in cycles, then the first path. Of a larger cycle it is the member with most
    links inside. A cycle that nobody touched in the window is a fossil.
    """
    members = dependency_cycles(fs)
    since = fs.anchor - F.expr(f"INTERVAL {fs.options.window_days} DAYS")
    recent = fs.dated_changes.where((F.col("date") >= since) & (F.col("date") <= fs.anchor)).groupBy("path").agg(F.sum(F.col("loc_added") + F.col("loc_deleted")).alias("churn"), F.count(F.lit(1)).alias("revs"))
    total = recent.agg(F.sum("churn").alias("total"))
    a, b = members.select("cycle_id", F.col("path").alias("src_path")), members.select("cycle_id", F.col("path").alias("target_path"))
    inside = fs.import_edges.join(a, "src_path").join(b, ["cycle_id", "target_path"])
    degree = inside.select("cycle_id", F.explode(F.array("src_path", "target_path")).alias("path")).groupBy("cycle_id", "path").agg(F.count(F.lit(1)).alias("degree"))
    busiest = degree.groupBy("cycle_id").agg(F.min_by("path", F.struct((-F.col("degree")).alias("k"), "path")).alias("busiest"))
    small = inside.join(members.where(F.col("size") <= TRIED_SIZE).select("cycle_id").distinct(), "cycle_id")
    tried = small.groupBy("cycle_id").applyInPandas(_extraction, "cycle_id long, tried string")  # at most 64 * 63 edges
    busiest = busiest.join(tried, "cycle_id", "left").select("cycle_id", F.coalesce("tried", "busiest").alias("extract_candidate"))
    names = members.withColumn("k", F.row_number().over(Window.partitionBy("cycle_id").orderBy("path"))).where("k <= 3").groupBy("cycle_id").agg(F.concat_ws(", ", F.transform(F.sort_array(F.collect_list(F.struct("k", "path"))), lambda x: x["path"])).alias("first_three"))
    heat = members.join(recent, "path", "left").groupBy("cycle_id", "size").agg(F.coalesce(F.sum("churn"), F.lit(0)).alias("churn"), F.coalesce(F.sum("revs"), F.lit(0)).alias("revs"))
    more = F.when(F.col("size") > 3, F.concat(F.lit(" +"), (F.col("size") - 3).cast("string"), F.lit(" more"))).otherwise("")
    return (
        heat.join(busiest, "cycle_id")
        .join(names, "cycle_id")
        .join(F.broadcast(total))
        .select(
            "cycle_id",
            "size",
            F.concat("first_three", more).alias("members_preview"),
            F.round(F.coalesce(100.0 * F.col("churn") / F.nullif("total", F.lit(0)), F.lit(0.0)), 6).alias("heat_pct"),
            F.when(F.col("revs") > 0, "live").otherwise("fossil").alias("verdict"),
            "extract_candidate",
        )
    )


def modularity_violations(fs: FactStore) -> DataFrame:
    """Coupled pairs that no dependency connects, whichever way."""
    r = reach(fs)
    ways = r.select(F.col("src").alias("entity_a"), F.col("dst").alias("entity_b")).unionByName(r.select(F.col("dst").alias("entity_a"), F.col("src").alias("entity_b")))
    pairs = coupling.rounded(fs).select("entity_a", "entity_b", "shared", "degree", "fisher_p")
    return pairs.join(ways, ["entity_a", "entity_b"], "left_anti")


def _coupled_neighbours(fs: FactStore) -> tuple[DataFrame, DataFrame]:
    """Per path how many dependents, and how many dependencies, it is also coupled with."""
    partners = coupling.partner_index(coupling.coupling(fs)).select("path", "partner")
    e = fs.import_edges
    up = e.select(F.col("target_path").alias("path"), F.col("src_path").alias("partner")).join(partners, ["path", "partner"]).groupBy("path").agg(F.count(F.lit(1)).alias("coupled_upstream"))
    down = e.select(F.col("src_path").alias("path"), F.col("target_path").alias("partner")).join(partners, ["path", "partner"]).groupBy("path").agg(F.count(F.lit(1)).alias("coupled_downstream"))
    return up, down


def unstable_interface(fs: FactStore, min_fan_in: int = 3) -> DataFrame:
    """Files that many depend on and that change along with dependents."""
    up, _ = _coupled_neighbours(fs)
    fan = fs.import_edges.groupBy(F.col("target_path").alias("path")).agg(F.count(F.lit(1)).alias("fan_in")).where(F.col("fan_in") >= min_fan_in)
    revs = churn.revisions(fs).withColumnRenamed("n_revs", "revisions")
    joined = fan.join(revs, "path").join(up.withColumnRenamed("coupled_upstream", "coupled_dependents"), "path")
    return joined.withColumn("instability_score", F.col("revisions") * F.col("coupled_dependents"))


def crossing(fs: FactStore, min_fan: int = 3) -> DataFrame:
    """Files with many links both ways that are coupled both ways."""
    up, down = _coupled_neighbours(fs)
    i = instability(fs).where((F.col("ca") >= min_fan) & (F.col("ce") >= min_fan))
    joined = i.join(up, "path").join(down, "path")
    return joined.select("path", F.col("ca").alias("fan_in"), F.col("ce").alias("fan_out"), "coupled_upstream", "coupled_downstream", (F.col("coupled_upstream") + F.col("coupled_downstream")).alias("crossing_score"))


LAYERS = {"front": (["apps", "services"], ["shared"]), "shared": (["libs", "packages", "crates"], []), "tooling": (["tools", "plugins"], ["shared", "front"])}


def layer_of(path: str, layers: dict[str, tuple[list[str], list[str]]]) -> Column:
    """The layer of a path by its first matching prefix; null if none matches."""
    chosen = F.lit(None).cast("string")
    for name, (prefixes, _) in reversed(list(layers.items())):
        for prefix in prefixes:
            chosen = F.when(F.col(path).startswith(prefix.rstrip("/") + "/"), name).otherwise(chosen)
    return chosen


def architecture_violations(fs: FactStore, layers: dict[str, tuple[list[str], list[str]]] | None = None) -> DataFrame:
    """Changes of coupled pairs across layers that may not depend on each other.

    ``layers``: name to (path prefixes, layers it may depend on). Dependencies of files that stay in their
    repository cannot cross layers here, so dependencies shown by co-change are judged as well.
    """
    rules = LAYERS if layers is None else layers
    for name, (_, allowed) in rules.items():
        if missing := set(allowed) - set(rules):
            raise ValueError(f"layer {name} depends on undeclared {sorted(missing)}")
    evident = coupling.coupling(fs).select(F.col("entity_a").alias("src_path"), F.col("entity_b").alias("target_path"))
    links = fs.import_edges.unionByName(evident)
    placed = links.select("src_path", "target_path", layer_of("src_path", rules).alias("src_layer"), layer_of("target_path", rules).alias("target_layer"))
    allowed = F.lit(False)
    for name, (_, may) in rules.items():
        if may:
            allowed = allowed | ((F.col("src_layer") == name) & F.col("target_layer").isin(may))
    return placed.where(F.col("src_layer").isNotNull() & F.col("target_layer").isNotNull() & (F.col("src_layer") != F.col("target_layer")) & ~allowed).distinct()


def centrality(fs: FactStore, rounds: int = 30, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """Degree, PageRank and eigenvector centrality over the coupled pairs.

    Both are power iterations over the edge table: one join and one aggregate a round, at most 30 rounds,
    ended when the ranks move by less than the tolerance in sum. Edges and ranks stay distributed.
    """
    edges = stage_table(coupling.partner_index(coupling.coupling(fs)).select("path", "partner", F.col("degree").alias("w")))
    nodes = stage_table(edges.groupBy("path").agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("strength")))
    n = nodes.count()
    if not n:
        return nodes.select("path", "degree", F.col("strength").alias("weighted_degree"), F.lit(0.0).alias("pagerank"), F.lit(0.0).alias("eigenvector"))
    ranks = stage_table(nodes.select("path", "strength", F.lit(1.0 / n).alias("pr"), F.lit(n**-0.5).alias("ev")))
    for _ in range(rounds):
        given = edges.join(ranks, "path").select(F.col("partner").alias("path"), (F.col("pr") * F.col("w") / F.col("strength")).alias("p"), (F.col("ev") * F.col("w")).alias("e"))
        got = given.groupBy("path").agg(F.sum("p").alias("p"), F.sum("e").alias("e"))
        raw = stage_table(
            ranks.join(got, "path").select("path", "strength", F.col("pr").alias("old"), F.col("ev").alias("old_ev"), ((1 - damping) / n + damping * F.col("p")).alias("pr"), (F.col("e") + F.col("ev")).alias("ev"))
        )
        length = raw.agg(F.sqrt(F.sum(F.col("ev") * F.col("ev"))).alias("l")).first()["l"]
        moved = raw.withColumn("ev", F.col("ev") / F.lit(length))
        shift = moved.agg(F.sum(F.abs(F.col("pr") - F.col("old"))).alias("a"), F.sum(F.abs(F.col("ev") - F.col("old_ev"))).alias("b")).first()
        following = stage_table(moved.select("path", "strength", "pr", "ev"))
        drop_staged(raw, ranks)
        ranks = following
        if shift["a"] < tolerance and shift["b"] < tolerance:
            break
    return ranks.join(nodes.select("path", "degree"), "path").select("path", "degree", F.round("strength", 6).alias("weighted_degree"), F.round("pr", 6).alias("pagerank"), F.round("ev", 6).alias("eigenvector"))


def communities(fs: FactStore, rounds: int = 20) -> DataFrame:
    """Communities of coupled paths by weighted label propagation: ``path``, ``community``, ``size``.

    A path takes the label with the greatest summed degree among its partners and itself, the least label
    between equals; rounds alternate between halves of the paths so that labels do not swing. Labels that
    are left apart within one connected part stay apart.
    """
    edges = stage_table(coupling.partner_index(coupling.coupling(fs)).select("path", "partner", F.col("degree").alias("w")))
    labels = held = stage_table(edges.select("path").distinct().withColumn("label", F.col("path")))
    for k in range(rounds):
        votes = edges.join(labels.select(F.col("path").alias("partner"), "label"), "partner").select("path", "label", "w")
        best = votes.groupBy("path", "label").agg(F.sum("w").alias("w")).groupBy("path").agg(F.min_by("label", F.struct((-F.round("w", 6)).alias("k"), "label")).alias("best"))
        half = F.pmod(F.xxhash64("path"), F.lit(2)) == k % 2
        following = stage_table(labels.join(best, "path").select("path", F.when(half, F.col("best")).otherwise(F.col("label")).alias("label"), (half & (F.col("best") != F.col("label"))).alias("moved")))
        changed = following.where("moved").take(1)
        drop_staged(held)
        held, labels = following, following.drop("moved")
        if not changed and k:
            break
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    return labels.join(sizes, "label").select("path", F.col("label").alias("community"), "size")


def modularity(fs: FactStore) -> DataFrame:
    """Weighted modularity of the communities. One row."""
    edges = coupling.partner_index(coupling.coupling(fs)).select("path", "partner", F.col("degree").alias("w"))
    c = stage_table(communities(fs).select("path", "community"))
    both = edges.join(c, "path").join(c.select(F.col("path").alias("partner"), F.col("community").alias("other")), "partner")
    per = both.groupBy("community").agg(F.sum(F.when(F.col("community") == F.col("other"), F.col("w")).otherwise(0.0)).alias("inside"), F.sum("w").alias("strength"))
    total = per.agg(F.sum("strength").alias("m2"))
    share = F.col("inside") / F.col("m2") - F.pow(F.col("strength") / F.col("m2"), F.lit(2))
    return per.join(F.broadcast(total)).agg(F.round(F.sum(share), 6).alias("modularity"), F.count(F.lit(1)).alias("communities"))


def connected_parts(fs: FactStore) -> DataFrame:
    """Connected parts of the coupled pairs: ``path``, ``part`` (its least path), by hooking to the least neighbour."""
    edges = stage_table(coupling.partner_index(coupling.coupling(fs)).select("path", "partner"))
    labels = stage_table(edges.groupBy("path").agg(F.least(F.first("path"), F.min("partner")).alias("part")))
    while True:
        near = edges.join(labels.select(F.col("path").alias("partner"), "part"), "partner").groupBy("path").agg(F.min("part").alias("near"))
        hooked = stage_table(labels.join(near, "path").select("path", "part", F.least("part", "near").alias("next")))
        # a label is itself a path: follow labels to the end before the next round
        forest = resolve_hierarchy(hooked.where("path <> next"), "path", "next").select(F.col("node").alias("path"), "root")
        following = stage_table(hooked.join(forest, "path", "left").select("path", F.col("part").alias("old"), F.coalesce("root", "next").alias("part")))
        done = not following.where("old <> part").take(1)
        labels = following.drop("old")
        if done:
            break
    return labels
