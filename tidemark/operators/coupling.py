"""Co-change: pairs of paths that change together, and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.stats import benjamini_hochberg, fisher_p
from tidemark.operators import churn
from tidemark.operators.pairs import frequent_pairs
from tidemark.operators.relations import bucketed
from tidemark.session import stage_table
from tidemark.sources.facts import FactStore, folder_of


def source_of(fs: FactStore) -> DataFrame:
    """The changes an analysis reads: by revision, or by day, week or month."""
    return fs.changes if fs.options.time_bucket is None else bucketed(fs)


def coupling_pairs(fs: FactStore, changes: DataFrame | None = None) -> DataFrame:
    """Pairs of paths with their shared and own revisions over moderate commits, before any threshold on degree.

    Commits above ``max_changeset_size`` paths are left out before pairs are made, so that a basket gives at
    most half its square; paths below ``min_revs`` revisions are removed before the pairs, which changes no
    result, as the threshold holds for both ends of a pair. With ``time_bucket``, pairs below ``min_coupling_pct``
    leave here already.
    """
    o = fs.options
    by_bucket = o.time_bucket is not None and changes is None
    if changes is not None:
        rows = changes
        good = churn.good_commits(fs, rows).select("rev")
    elif o.time_bucket is None:
        rows, good = fs.changes, churn.good_commits(fs).select("rev")
    else:
        rows = bucketed(fs)
        sizes = fs.changes.groupBy("rev").agg(F.count(F.lit(1)).alias("n")).join(fs.commits.select("rev", F.date_trunc(o.time_bucket, "date").alias("at")), "rev")
        key = F.date_format("at", "yyyy-MM-dd").alias("rev")
        good = sizes.groupBy(key).agg(F.max("n").alias("n")).where(F.col("n") <= o.max_changeset_size).select("rev")
    kept = fs.once(("good rows", id(changes), o), lambda: rows.select("rev", "path").join(good, "rev"))
    if by_bucket:
        kept = stage_table(kept)
    n = kept.agg(F.count_distinct("rev").alias("n"))
    revs = kept.groupBy("path").agg(F.count(F.lit(1)).alias("revs"))
    frequent = revs if o.compat else revs.where(F.col("revs") >= o.min_revs)
    if by_bucket:
        # a day or month holds all paths of its commits: too many pairs to move
        pairs = frequent_pairs(kept.join(frequent.select("path"), "path"), "rev", "path", o.min_shared_revs, o.min_coupling_pct / 200).withColumnsRenamed({"a": "entity_a", "b": "entity_b"})
        return _with_revs(pairs, frequent, n)
    baskets = kept.join(frequent.select("path"), "path").groupBy("rev").agg(F.sort_array(F.collect_set("path")).alias("paths"))
    pairs = (
        baskets.where(F.size("paths") > 1)
        .select("paths", F.posexplode("paths").alias("pos", "entity_a"))
        .select("entity_a", F.explode(F.slice("paths", F.col("pos") + 2, F.size("paths"))).alias("entity_b"))
        .groupBy("entity_a", "entity_b")
        .agg(F.count(F.lit(1)).alias("shared"))
        .where(F.col("shared") >= o.min_shared_revs)
    )
    return _with_revs(pairs, frequent, n)


def _with_revs(pairs: DataFrame, frequent: DataFrame, n: DataFrame) -> DataFrame:
    """Pairs with the revisions of both ends and the number of all revisions."""
    return (
        pairs.join(frequent.select(F.col("path").alias("entity_a"), F.col("revs").alias("revs_a")), "entity_a")
        .join(frequent.select(F.col("path").alias("entity_b"), F.col("revs").alias("revs_b")), "entity_b")
        .join(F.broadcast(n))
    )


def coupling(fs: FactStore, changes: DataFrame | None = None) -> DataFrame:
    """Significantly coupled pairs: shared and own revisions, average, degree in percent and exact p.

    In ``compat`` the average rounds up, ``min_revs`` holds for it, and no test gates the pairs.
    """
    o = fs.options
    both = F.col("revs_a") + F.col("revs_b")
    pairs = coupling_pairs(fs, changes).withColumn("degree", F.lit(200.0) * F.col("shared") / both)
    pairs = pairs.where((F.col("degree") >= o.min_coupling_pct) & (F.col("degree") <= o.max_coupling_pct))
    average = F.ceil(both / 2) if o.compat else F.floor(both / 2)
    tested = pairs.select("entity_a", "entity_b", "shared", "revs_a", "revs_b", average.alias("average_revs"), "degree", fisher_p("shared", "revs_a", "revs_b", "n").alias("fisher_p"))
    if o.compat:
        return tested.where(F.col("average_revs") >= o.min_revs)
    if o.fdr_correction:
        return benjamini_hochberg(tested, "fisher_p", o.significance)
    return tested.where(F.col("fisher_p") < o.significance)


def rounded(fs: FactStore) -> DataFrame:
    """Coupling with rounded measures for reporting."""
    return coupling(fs).withColumn("degree", F.round("degree", 6)).withColumn("fisher_p", F.round("fisher_p", 7))


def partner_index(pairs: DataFrame) -> DataFrame:
    """Both directions of coupled pairs: ``path``, ``partner``, ``degree``."""
    a = pairs.select(F.col("entity_a").alias("path"), F.col("entity_b").alias("partner"), "degree")
    return a.unionByName(pairs.select(F.col("entity_b").alias("path"), F.col("entity_a").alias("partner"), "degree"))


def partners(fs: FactStore) -> DataFrame:
    """The partner index of the significant pairs."""
    return partner_index(coupling(fs)).withColumn("degree", F.round("degree", 6))


def coupling_absences(fs: FactStore, touched: DataFrame) -> DataFrame:
    """Partners that a change set left out: ``touched_file``, ``expected_partner``, ``degree``."""
    files = touched.select(F.col("path").alias("touched_file")).distinct()
    expected = partner_index(coupling(fs)).select(F.col("path").alias("touched_file"), F.col("partner").alias("expected_partner"), F.round("degree", 6).alias("degree"))
    return expected.join(files, "touched_file", "left_semi").join(files.select(F.col("touched_file").alias("expected_partner")), "expected_partner", "left_anti")


def coupling_absences_of_latest(fs: FactStore) -> DataFrame:
    """Absences of the hundred newest commits taken as one change set."""
    newest = fs.commits.where("seq < 100").select("rev")
    return coupling_absences(fs, fs.changes.join(newest, "rev", "left_semi"))


def coupling_density(fs: FactStore) -> DataFrame:
    """Coupled pairs over possible pairs of the paths that take part. One row."""
    pairs = coupling(fs)
    nodes = partner_index(pairs).agg(F.count_distinct("path").alias("nodes"))
    edges = pairs.agg(F.count(F.lit(1)).alias("edges"))
    possible = F.col("nodes") * (F.col("nodes") - 1) / 2.0
    density = F.when(F.col("nodes") > 1, F.least(F.lit(1.0), F.col("edges") / possible)).otherwise(0.0)
    return nodes.join(F.broadcast(edges)).select("nodes", "edges", F.round(density, 9).alias("density"))


def coupling_degree(fs: FactStore) -> DataFrame:
    """Partners and summed degree of every coupled path."""
    return partner_index(coupling(fs)).groupBy("path").agg(F.count(F.lit(1)).alias("degree"), F.round(F.sum("degree"), 6).alias("weighted_degree"))


def clone_coupling(fs: FactStore) -> DataFrame:
    """Duplicated fragments whose files also change together.

    Fragments pair up by path within a family, each pair of files once per family. A pair is at risk if the
    main author of either file has left.
    """
    from tidemark.operators.ownership import knowledge_islands

    o = fs.options
    kept = fs.clones.where(F.col("node_count") >= o.min_clone_node_count)
    if "similarity" in kept.columns:
        kept = kept.where(F.col("similarity") >= o.clone_similarity_floor)
    members = kept.groupBy("fingerprint", "path").agg(F.max("node_count").alias("node_count"), F.min("start_line").alias("start_line"))
    pairs = fs.with_options(min_shared_revs=o.min_clone_shared_revs)
    coupled = coupling(pairs)
    # coupled pairs are few: each brings its own families instead of pairing whole families
    left = members.select("fingerprint", F.col("path").alias("file_a"), "node_count")
    right = members.select("fingerprint", F.col("path").alias("file_b"))
    joined = coupled.withColumnsRenamed({"entity_a": "file_a", "entity_b": "file_b"}).join(left, "file_a").join(right, ["fingerprint", "file_b"])
    if o.clone_skip_same_dir:
        joined = joined.where(folder_of("file_a") != folder_of("file_b"))
    islands = knowledge_islands(fs).select("entity", F.lit(True).alias("island"))
    left, right = islands.select(F.col("entity").alias("file_a"), F.col("island").alias("island_a")), islands.select(F.col("entity").alias("file_b"), F.col("island").alias("island_b"))
    return joined.join(left, "file_a", "left").join(right, "file_b", "left").select(
        "fingerprint",
        "file_a",
        "file_b",
        (F.coalesce("island_a", F.lit(False)) | F.coalesce("island_b", F.lit(False))).alias("at_risk"),
        F.round("fisher_p", 7).alias("p_value"),
        "node_count",
        F.lit(1.0).alias("similarity"),
        F.col("shared").alias("shared_revs"),
        F.col("revs_a").alias("support_a"),
        F.col("revs_b").alias("support_b"),
        F.round("degree", 6).alias("degree_pct"),
        F.round(F.col("degree") / 100 * (1 - F.col("fisher_p")), 6).alias("combined_score"),
    )


def touched_functions(fs: FactStore, target: str | None = None) -> DataFrame:
    """Functions that each revision's regions overlap: ``rev``, ``path``, ``name``.

    A pure deletion (no new lines) touches the function it starts in. Regions and functions of one file
    meet by path; the overlap is a residual condition of that join.
    """
    hunks, functions = fs.hunks, fs.functions
    if target is not None:
        hunks, functions = hunks.where(F.col("path") == target), functions.where(F.col("path") == target)
    h, f = hunks.alias("h"), functions.alias("f")
    last = F.greatest(F.col("h.new_start"), F.col("h.new_start") + F.col("h.new_lines") - 1)
    overlap = (F.col("h.path") == F.col("f.path")) & (F.col("h.new_start") <= F.col("f.end_line")) & (last >= F.col("f.start_line"))
    return h.join(f, overlap).select("h.rev", "h.path", "f.name").distinct()


def function_coupling(fs: FactStore) -> DataFrame:
    """Functions of one file that change together."""
    o = fs.options
    hits = touched_functions(fs, o.target)
    n = fs.hunks.where(F.col("path") == o.target).agg(F.count_distinct("rev").alias("n"))
    own = hits.groupBy("name").agg(F.count(F.lit(1)).alias("changes"))
    # one file's functions bound the array
    together = hits.groupBy("rev").agg(F.sort_array(F.collect_set("name")).alias("names")).where(F.size("names") > 1)
    pairs = (
        together.select("names", F.posexplode("names").alias("pos", "a"))
        .select("a", F.explode(F.slice("names", F.col("pos") + 2, F.size("names"))).alias("b"))
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("co_changes"))
        .where("co_changes >= 2")
    )
    return (
        pairs.join(own.select(F.col("name").alias("a"), F.col("changes").alias("a_changes")), "a")
        .join(own.select(F.col("name").alias("b"), F.col("changes").alias("b_changes")), "b")
        .join(F.broadcast(n))
        .select(
            "a",
            "b",
            "co_changes",
            "a_changes",
            "b_changes",
            (F.col("co_changes") / F.greatest(F.least("a_changes", "b_changes"), F.lit(1))).alias("confidence"),
            F.round(fisher_p("co_changes", "a_changes", "b_changes", "n"), 7).alias("p_value"),
        )
    )

