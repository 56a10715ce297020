"""Quality gates: filters over results that were computed once, as one table of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import delivery, ownership, rankings, structure
from tidemark.session import stage_table
from tidemark.sources.facts import FactStore

VIOLATION = "gate string, path string, actual double, threshold double"


def violations(rows: DataFrame, gate: str, value: str, threshold: float, above: bool, path: Column | None = None) -> DataFrame:
    """Rows whose value is beyond a threshold, as violations of a gate; null values were not measured."""
    bad = F.col(value) > threshold if above else F.col(value) < threshold
    where = F.col("path") if path is None else path
    return rows.where(bad).select(F.lit(gate).alias("gate"), where.alias("path"), F.col(value).cast("double").alias("actual"), F.lit(float(threshold)).alias("threshold"))


def evaluate_gates(fs: FactStore, limits: dict[str, float]) -> DataFrame:
    """All violations of the given limits: ``gate``, ``path`` (null for whole-repository gates), ``actual``, ``threshold``.

    Known gates: cognitive_max, hotspot_score_max, hotspot_anchored_max, code_health_min,
    corpus_percentile_max, max_dependency_cycles, max_propagation_cost, max_red_effort_pct,
    code_familiarity_min, max_findings_in_hot_files, max_clone_family, disallow_clone_type_1 (1 to demand that
    there is no exact copy) and born_health_min (health of files born in the window). Each analysis runs
    once, whatever the number of its gates.
    """
    none = F.lit(None).cast("string")
    found: list[DataFrame] = []
    wanted = set(limits)
    known = {"cognitive_max", "hotspot_score_max", "hotspot_anchored_max", "code_health_min", "corpus_percentile_max", "max_dependency_cycles", "max_propagation_cost", "max_red_effort_pct", "code_familiarity_min", "max_findings_in_hot_files", "max_clone_family", "disallow_clone_type_1", "born_health_min"}
    if unknown := wanted - known:
        raise ValueError(f"unknown gates {sorted(unknown)}")

    def gate(rows: DataFrame, name: str, value: str, above: bool = True, path: Column | None = None) -> None:
        if name in limits:
            found.append(violations(rows, name, value, limits[name], above, path))

    if wanted & {"cognitive_max", "hotspot_score_max"}:
        hot = stage_table(rankings.hotspots(fs))
        gate(hot, "cognitive_max", "cognitive")
        gate(hot, "hotspot_score_max", "hotspot_score")
    if "hotspot_anchored_max" in wanted:
        gate(rankings.hotspots_anchored(fs), "hotspot_anchored_max", "hotspot_score_anchored")
    if "code_health_min" in wanted:
        gate(rankings.code_health(fs), "code_health_min", "score", above=False)
    if "corpus_percentile_max" in wanted:
        gate(rankings.corpus_percentiles(fs), "corpus_percentile_max", "corpus_percentile")
    if wanted & {"max_dependency_cycles", "max_propagation_cost"}:
        measured = structure.architecture_metrics(fs)
        one = measured.where("metric in ('cycles', 'propagation_cost')").select("metric", F.col("value").cast("double").alias("v"))
        gate(one.where("metric = 'cycles'"), "max_dependency_cycles", "v", path=none)
        gate(one.where("metric = 'propagation_cost'"), "max_propagation_cost", "v", path=none)
    if "max_red_effort_pct" in wanted:
        gate(rankings.effort_exposure(fs).where("band = 'red'"), "max_red_effort_pct", "churn_share_pct", path=none)
    if "code_familiarity_min" in wanted:
        gate(ownership.code_familiarity(fs), "code_familiarity_min", "familiarity_pct", above=False, path=none)
    if "max_findings_in_hot_files" in wanted:
        hot_findings = rankings.finding_hotspot_overlap(fs).where("priority = 'act-now'").agg(F.count(F.lit(1)).alias("v"))
        gate(hot_findings, "max_findings_in_hot_files", "v", path=none)
    if "max_clone_family" in wanted:
        gate(rankings.clones(fs).withColumnRenamed("entity", "path").groupBy("path").agg(F.max("family_size").alias("v")), "max_clone_family", "v")
    if limits.get("disallow_clone_type_1"):
        families = rankings.clones(fs).where("similarity >= 1").agg(F.count_distinct("fingerprint").alias("v"))
        found.append(violations(families, "disallow_clone_type_1", "v", 0, above=True, path=none))
    if "born_health_min" in wanted:
        born = delivery.new_code(fs).where("scope = 'born'").select("path")
        gate(rankings.code_health(fs).join(born, "path", "left_semi"), "born_health_min", "score", above=False)
    return reduce(DataFrame.unionByName, found) if found else fs.spark.createDataFrame([], VIOLATION)


def verdicts(found: DataFrame, measured: dict[str, bool]) -> DataFrame:
    """One verdict per gate: skipped if it was not measured, else failed or passed."""
    failed = found.groupBy("gate").agg(F.count(F.lit(1)).alias("violations"))
    gates = found.sparkSession.createDataFrame(sorted(measured.items()), "gate string, measured boolean")
    joined = gates.join(failed, "gate", "left").withColumn("violations", F.coalesce("violations", F.lit(0)))
    return joined.select("gate", F.when(~F.col("measured"), "skipped").when(F.col("violations") > 0, "failed").otherwise("passed").alias("verdict"), "violations")


def ratchet(current: DataFrame, snapshot: DataFrame, epsilon: float = 1e-9) -> DataFrame:
    """Metrics that got worse than their snapshot, or vanished: ``metric``, ``was``, ``now``, ``reason``.

    Inputs: ``metric``, ``value``, and in the snapshot ``higher_is_better``.
    """
    joined = snapshot.select("metric", F.col("value").alias("was"), "higher_is_better").join(current.select("metric", F.col("value").alias("now")), "metric", "left")
    worse = F.when(F.col("higher_is_better"), F.col("now") < F.col("was") - epsilon).otherwise(F.col("now") > F.col("was") + epsilon)
    return joined.withColumn("reason", F.when(F.col("now").isNull(), "missing").when(worse, "worse")).where("reason is not null").drop("higher_is_better")


LIMITS = {"cognitive_max": 4, "hotspot_score_max": 8.0, "code_health_min": 55.0, "max_dependency_cycles": 0, "code_familiarity_min": 99.0, "max_clone_family": 40}


def gate_violations(fs: FactStore) -> DataFrame:
    """Violations of an example set of limits."""
    return evaluate_gates(fs, LIMITS)


def gate_verdicts(fs: FactStore) -> DataFrame:
    """Verdicts of the example set, with one gate that nothing measured."""
    return verdicts(evaluate_gates(fs, LIMITS), {**{name: True for name in LIMITS}, "max_findings_in_hot_files": False})
