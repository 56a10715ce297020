"""Registered rankings with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import coupling
from tidemark.operators import rankings as rank
from tidemark.plans.coupling_queries import coupling_ctes
from tidemark.plans.facts_sql import AS_OF, with_facts
from tidemark.plans.ownership_queries import KNOWLEDGE

_THIN = {"min_coupling_pct": 20.0, "min_shared_revs": 3}
TARGET_SQL = "(SELECT path FROM fn GROUP BY 1 ORDER BY count(*) DESC, path LIMIT 1)"


def _with_target(analysis):
    """Run an analysis of one file on the file with most functions."""

    def run(fs):
        best = fs.functions.groupBy("path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(1).collect()
        return analysis(fs.with_options(target=best[0]["path"] if best else ""))

    return run


ANALYSES = {
    "hotspots": (rank.hotspots, {}),
    "hotspots_by_week": (rank.hotspots, {"time_bucket": "week"}),
    "hotspots_anchored": (rank.hotspots_anchored, {}),
    "mi_bands": (rank.mi_bands, {}),
    "fans": (rank.fans, {}),
    "god_classes": (lambda fs: rank.god_classes(fs, 2, 4), {}),
    "clones": (rank.clones, {}),
    "head_clone_counts": (rank.head_clone_counts, {}),
    "biomarkers": (rank.biomarker_table, _THIN),
    "code_health": (rank.code_health, _THIN),
    "corpus_lens": (rank.corpus_lens, {}),
    "refactoring_targets": (rank.refactoring_targets, _THIN),
    "touched_functions": (coupling.touched_functions, {}),
    "function_hotspots": (rank.function_hotspots, {"min_revs": 2}),
    "function_xray": (_with_target(rank.function_xray), {}),
    "function_coupling": (_with_target(coupling.function_coupling), {}),
    "delivery_friction": (rank.delivery_friction, {}),
    "effort_exposure": (rank.effort_exposure, _THIN),
    "coordination_needs": (rank.coordination_needs, _THIN),
    "cochange_entropy": (rank.cochange_entropy, {}),
    "marginal_owner_risk": (rank.marginal_owner_risk, _THIN),
    "finding_hotspot_overlap": (rank.finding_hotspot_overlap, _THIN),
}

_HEALTH = "greatest(0, least(100, 100 * (1 - 0.4::DOUBLE * coalesce(cognitive / nullif(peak, 0)::DOUBLE, 0))))"
_BAND = "CASE WHEN structural_risk >= 0.55 THEN 'red' WHEN structural_risk >= 0.28 THEN 'yellow' ELSE 'green' END"


def _hot(revs: str) -> dict[str, str]:
    return {
        "sc": f"SELECT r.path, revisions, cognitive, round(mi, 9) AS mi, max(cognitive) OVER () AS peak FROM ({revs}) r JOIN f USING (path)",
        "hot": f"""SELECT path, revisions, cognitive, {_HEALTH} AS health, percent_rank() OVER (ORDER BY revisions) * percent_rank() OVER (ORDER BY cognitive) AS rk, mi, percent_rank() OVER (ORDER BY mi) AS mi_rank FROM sc""",
        "hs": """SELECT path, revisions, cognitive, round(health, 6) AS cognitive_health, round(rk * (100 - health) / 4, 9) AS hotspot_score, round(mi, 6) AS mi, round(mi_rank, 9) AS mi_rank, round(100.0::DOUBLE * ai / n, 6) AS ai_pct
 FROM hot JOIN (SELECT path, count(*) AS n, count(*) FILTER (ai_attribution IN ('ai-authored', 'ai-assisted')) AS ai FROM dc GROUP BY 1) USING (path)""",
    }


_REVS = "SELECT path, count(*) AS revisions FROM ch GROUP BY 1 HAVING count(*) >= 5"
_WILSON = "(p + 3.8416::DOUBLE / (2 * n) {sign} 1.96::DOUBLE * sqrt(p * (1 - p) / n + 3.8416::DOUBLE / (4 * n * n))) / (1 + 3.8416::DOUBLE / n)"
CORPUS = {
    "sz_": "SELECT lang, sum(sample_functions) AS samples FROM (SELECT DISTINCT artifact_id, lang, sloc_min, sloc_max, sample_functions FROM strata) GROUP BY 1 HAVING sum(sample_functions) >= 500",
    "sr": """SELECT sz_.lang, sloc_min, sloc_max, sample_functions, metric, q, samples FROM (SELECT lang, sloc_min, sloc_max, sample_functions, m.metric AS metric, list_filter(m.quantiles, lambda x: x IS NOT NULL AND NOT isnan(x)) AS q
 FROM (SELECT DISTINCT artifact_id, lang, sloc_min, sloc_max, sample_functions, unnest(metrics) AS m FROM strata)) z JOIN sz_ ON sz_.lang = z.lang WHERE metric IN ('cyclomatic', 'cognitive', 'sloc', 'nargs', 'max_nesting') AND len(q) > 0""",
    "fv_": " UNION ALL ".join(f"SELECT path, lang, sloc AS size, '{m}' AS metric, {m}::DOUBLE AS v FROM f" for m in ("cyclomatic", "cognitive", "sloc", "nargs", "max_nesting")),
    "cpm": """SELECT path, fv_.metric, round(sum((len(list_filter(q, lambda x: x < v)) + len(list_filter(q, lambda x: x <= v))) / (len(q) * 2.0::DOUBLE) * sample_functions) / sum(sample_functions), 9) AS p, max(samples) AS samples
 FROM fv_ JOIN sr ON fv_.lang = sr.lang AND fv_.metric = sr.metric AND size >= sr.sloc_min AND size <= sr.sloc_max GROUP BY 1, 2""",
    "cpt": "SELECT path, max(p) AS corpus_percentile, max(samples)::DOUBLE AS samples FROM cpm GROUP BY 1",
    "lens": f"""SELECT path, p AS corpus_percentile, p >= 0.99 AS beyond_corpus, round(greatest(0, {_WILSON.format(sign="-")}), 9) AS ci_low, round(least(1, {_WILSON.format(sign="+")}), 9) AS ci_high
 FROM (SELECT path, corpus_percentile AS p, samples AS n FROM cpt)""",
}
FANS = {
    "fan": """SELECT path, cognitive, coalesce(fi, 0) AS fan_in, coalesce(fo, 0) AS fan_out FROM f
 LEFT JOIN (SELECT target_path AS path, count(DISTINCT src_path) AS fi FROM im WHERE resolved GROUP BY 1) USING (path)
 LEFT JOIN (SELECT src_path AS path, count(DISTINCT target) AS fo FROM im GROUP BY 1) USING (path)""",
}
TOUCHED = {
    "tf": "SELECT DISTINCT hk.rev, hk.path, fn.name FROM hk JOIN fn ON hk.path = fn.path AND hk.new_start <= fn.end_line AND greatest(hk.new_start, hk.new_start + hk.new_lines - 1) >= fn.start_line",
}
_W = {"complex-method": 0.22, "god-class": 0.18, "large-method": 0.12, "dry": 0.12, "shotgun": 0.12, "nesting": 0.10, "args": 0.07, "conditional": 0.07}
HEALTH = {
    **coupling_ctes(),
    **FANS,
    "co": "SELECT lang FROM f GROUP BY 1 HAVING count(*) >= 10",
    "hcc": "SELECT path, count(*) AS clones FROM cl GROUP BY 1",
    "ba": """SELECT f.path, f.lang, f.cognitive, coalesce(lm.large, 0) AS large, coalesce(hcc.clones, 0) AS dry, coalesce(fan.cognitive * (fan_in + fan_out), 0) AS god, max_nesting, nargs, bool_ops
 FROM f JOIN co ON co.lang = f.lang LEFT JOIN (SELECT path, max(loc) AS large FROM fn GROUP BY 1) lm ON lm.path = f.path LEFT JOIN hcc ON hcc.path = f.path LEFT JOIN fan ON fan.path = f.path""",
    "bm": " UNION ALL ".join(
        f"SELECT path, lang, '{s}' AS smell, {f'CASE WHEN {c} <= 0 THEN 0 ELSE ' if s in ('god-class', 'dry') else ''}percent_rank() OVER (PARTITION BY lang ORDER BY {c}){' END' if s in ('god-class', 'dry') else ''}::DOUBLE AS intensity FROM ba"
        for s, c in {"complex-method": "cognitive", "god-class": "god", "large-method": "large", "dry": "dry", "nesting": "max_nesting", "args": "nargs", "conditional": "bool_ops"}.items()
    )
    + " UNION ALL SELECT path, lang, 'shotgun', r FROM (SELECT path, percent_rank() OVER (ORDER BY n) AS r FROM (SELECT path, count(*) AS n FROM ix GROUP BY 1)) JOIN ba USING (path)",
    "rk": f"""SELECT path, lang, round(least(1.0, sum(intensity * CASE smell {' '.join(f"WHEN '{s}' THEN {w}::DOUBLE" for s, w in _W.items())} END)), 9) AS structural_risk,
 CASE WHEN max(intensity) > 0 THEN first(smell ORDER BY round(intensity, 9) DESC, smell) ELSE 'none' END AS dominant_type FROM bm GROUP BY 1, 2""",
}
_FV = "SELECT path, 1 - sum(n * n)::DOUBLE / (sum(n)::DOUBLE * sum(n)::DOUBLE) AS fv FROM (SELECT path, canonical_author, count(*) AS n FROM dc GROUP BY 1, 2) GROUP BY 1"
_HOTSPOTS = "SELECT * FROM hs"

ENTROPY = {
    "rcn": f"SELECT rev, path FROM dc WHERE date >= {AS_OF} - INTERVAL 90 DAYS AND date <= {AS_OF}",
    "en": """SELECT path, round(-(d / t) * log2(d / t), 9) AS cochange_entropy FROM (SELECT path, d::DOUBLE AS d, (sum(d) OVER ())::DOUBLE AS t FROM (
 SELECT path, sum(n - 1) AS d FROM rcn JOIN (SELECT rev, count(*) AS n FROM rcn GROUP BY 1 HAVING count(*) <= 30) USING (rev) GROUP BY 1 HAVING sum(n - 1) > 0))""",
}

SQL = {
    "hotspots": with_facts(_HOTSPOTS, _hot(_REVS)),
    "hotspots_by_week": with_facts(
        _HOTSPOTS, _hot("SELECT path, count(*) AS revisions FROM (SELECT DISTINCT date_trunc('week', date) AS w, path FROM dc) GROUP BY 1 HAVING count(*) >= 5")
    ),
    "hotspots_anchored": with_facts(
        """SELECT path, n_revs AS revisions, corpus_percentile, round(r * corpus_percentile * (100 - greatest(0, least(100, 100 * (1 - 0.4::DOUBLE * corpus_percentile)))) / 4, 9) AS hotspot_score_anchored
 FROM (SELECT *, percent_rank() OVER (ORDER BY n_revs) AS r FROM pr) JOIN cpt USING (path)""",
        CORPUS,
    ),
    "mi_bands": with_facts("SELECT path, CASE WHEN r >= 0.75 THEN 'high' WHEN r >= 0.25 THEN 'moderate' ELSE 'low' END AS band FROM (SELECT path, percent_rank() OVER (ORDER BY round(mi, 9)) AS r FROM f)"),
    "fans": with_facts("SELECT * FROM fan", FANS),
    "god_classes": with_facts("SELECT *, cognitive / 100.0::DOUBLE * (fan_in + fan_out) AS god_score FROM fan WHERE cognitive >= 2 AND fan_in + fan_out >= 4", FANS),
    "clones": with_facts("SELECT fingerprint, path AS entity, start_line, end_line, node_count, 1.0::DOUBLE AS similarity, family_size FROM cl"),
    "head_clone_counts": with_facts("SELECT path, count(*) AS clones FROM cl GROUP BY 1"),
    "biomarkers": with_facts("SELECT path, lang, smell, round(intensity, 9) AS intensity FROM bm", HEALTH),
    "code_health": with_facts(
        f"""SELECT path, lang, cognitive, round(greatest(0, least(100, 100 * (1 - 0.5::DOUBLE * structural_risk - 0.3::DOUBLE * coalesce(churn / nullif(max(churn) OVER (), 0)::DOUBLE, 0) - 0.2::DOUBLE * coalesce(fv, 0)))), 6) AS score,
 structural_risk, round(percent_rank() OVER (PARTITION BY lang ORDER BY structural_risk), 9) AS percentile, {_BAND} AS band, dominant_type, corpus_percentile, beyond_corpus, ci_low, ci_high
 FROM (SELECT rk.*, f.cognitive, coalesce(x.churn, 0) AS churn, fv FROM rk JOIN f USING (path) LEFT JOIN (SELECT path, sum(loc_added + loc_deleted) AS churn FROM ch GROUP BY 1) x USING (path) LEFT JOIN ({_FV}) USING (path)) LEFT JOIN lens USING (path)""",
        {**HEALTH, **CORPUS},
    ),
    "corpus_lens": with_facts("SELECT * FROM lens", CORPUS),
    "refactoring_targets": with_facts(
        f"""SELECT path, round(structural_risk * hotspot_score / greatest(loc, 25), 9) AS priority, round(structural_risk * hotspot_score, 9) AS combined_risk, structural_risk, hotspot_score, revisions, loc, dominant_type, {_BAND} AS band,
 row_number() OVER (ORDER BY loc, path) AS manual_up_rank FROM rk JOIN hs USING (path) JOIN (SELECT path, loc FROM f) USING (path)""",
        {**HEALTH, **_hot(_REVS)},
    ),
    "touched_functions": with_facts("SELECT * FROM tf", TOUCHED),
    "function_hotspots": with_facts(
        f"""SELECT path, name AS function, revs, cognitive, round(h, 6) AS cognitive_health, round(rk * (100 - h) / 4, 9) AS function_hotspot_score FROM (
 SELECT path, name, revs, cognitive, {_HEALTH} AS h, percent_rank() OVER (ORDER BY revs) * percent_rank() OVER (ORDER BY cognitive) AS rk FROM (
 SELECT path, name, revs, cognitive, max(cognitive) OVER () AS peak FROM (SELECT path, name, count(*) AS revs FROM tf GROUP BY 1, 2 HAVING count(*) >= 2) JOIN fn USING (path, name)))""",
        TOUCHED,
    ),
    "function_xray": with_facts(
        f"""SELECT name AS function, coalesce(n, 0) AS change_freq, loc, cyclomatic, cognitive, strftime(last_at, '%Y-%m-%d') AS last_changed FROM fn
 LEFT JOIN (SELECT name, count(*) AS n, max(date) AS last_at FROM tf JOIN c USING (rev) WHERE path = {TARGET_SQL} GROUP BY 1) USING (name) WHERE path = {TARGET_SQL}""",
        TOUCHED,
    ),
    "delivery_friction": with_facts(
        f"""SELECT path, revisions, cognitive, round(med, 6) AS median_lead_time_days, round(p95, 6) AS p95_lead_time_days, date_diff('day', last_landed, {AS_OF})::BIGINT AS wip_age_days,
 round(coalesce(percent_rank() OVER (ORDER BY revisions) * rl * percent_rank() OVER (ORDER BY cognitive) * 100, 0), 9) AS friction_score FROM (
 SELECT k.*, CASE WHEN med IS NOT NULL THEN percent_rank() OVER (PARTITION BY med IS NULL ORDER BY med) END AS rl FROM (
 SELECT path, revisions, coalesce(cognitive, 0) AS cognitive, med, p95, last_landed FROM (
 SELECT path, count(*) AS revisions, quantile_cont(lead, 0.5) / 86400 AS med, quantile_cont(lead, 0.95) / 86400 AS p95, max(committer_date) AS last_landed FROM (
 SELECT *, CASE WHEN committer_date > date THEN (epoch_us(committer_date) - epoch_us(date)) / 1e6::DOUBLE END AS lead FROM dc) GROUP BY 1 HAVING count(*) >= 5) LEFT JOIN f USING (path)) k)"""
    ),
    "effort_exposure": with_facts(
        f"""SELECT band, files, round(100.0::DOUBLE * sloc / sum(sloc) OVER (), 6) AS loc_share_pct, round(100.0::DOUBLE * commits / nullif(n, 0), 6) AS commit_share_pct, round(100.0::DOUBLE * churn / nullif(sum(churn) OVER (), 0), 6) AS churn_share_pct,
 round(100 * greatest(0, ((p + 3.8416::DOUBLE / (2 * n)) - 1.96::DOUBLE * sqrt(p * (1 - p) / n + 3.8416::DOUBLE / (4 * n * n))) / (1 + 3.8416::DOUBLE / n)), 6) AS ci_low,
 round(100 * least(1, ((p + 3.8416::DOUBLE / (2 * n)) + 1.96::DOUBLE * sqrt(p * (1 - p) / n + 3.8416::DOUBLE / (4 * n * n))) / (1 + 3.8416::DOUBLE / n)), 6) AS ci_high
 FROM (SELECT band, files, sloc, coalesce(commits, 0) AS commits, coalesce(churn, 0) AS churn, n, coalesce(commits, 0) / n::DOUBLE AS p FROM (SELECT band, count(*) AS files, sum(sloc) AS sloc FROM bd GROUP BY 1)
 LEFT JOIN (SELECT band, count(DISTINCT rev) AS commits, sum(loc_added + loc_deleted) AS churn FROM rc GROUP BY 1) USING (band), (SELECT count(DISTINCT rev)::DOUBLE AS n FROM rc))""",
        {
            **HEALTH,
            "bd": f"SELECT rk.path, {_BAND} AS band, f.sloc FROM rk JOIN f USING (path)",
            "rc": f"SELECT dc.*, bd.band FROM dc JOIN bd USING (path) WHERE date >= {AS_OF} - INTERVAL 90 DAYS AND date <= {AS_OF}",
        },
    ),
    "coordination_needs": with_facts(
        f"""SELECT path, authors, fragmentation, interleave, coalesce(cochange_entropy, 0) AS cochange_entropy, health_band, CASE WHEN authors <= 1 THEN 'single' WHEN fragmentation < 0.25 THEN 'low' WHEN fragmentation >= 0.5 AND interleave >= 0.5 THEN 'high' ELSE 'medium' END AS tier, total_commits FROM (
 SELECT p.path, authors, round(coalesce(1 - sq, 0), 9) AS fragmentation, round(CASE WHEN n > 1 THEN sw / (n - 1)::DOUBLE ELSE 0 END, 9) AS interleave, n AS total_commits FROM (
 SELECT path, count(*) AS n, count(*) FILTER (prev IS NOT NULL AND prev <> canonical_author) AS sw, count(DISTINCT CASE WHEN date >= {AS_OF} - INTERVAL 90 DAYS AND date <= {AS_OF} THEN canonical_author END) AS authors FROM (
 SELECT *, lag(canonical_author) OVER (PARTITION BY path ORDER BY date, seq DESC) AS prev FROM dc) GROUP BY 1) p JOIN live ON live.path = p.path LEFT JOIN (SELECT path, sum(k_norm * k_norm) AS sq FROM ks GROUP BY 1) s ON s.path = p.path)
 LEFT JOIN en USING (path) LEFT JOIN (SELECT path, {_BAND} AS health_band FROM rk) USING (path)""",
        {**KNOWLEDGE, **HEALTH, **ENTROPY},
    ),
    "cochange_entropy": with_facts("SELECT * FROM en", ENTROPY),
    "marginal_owner_risk": with_facts(
        f"""SELECT *, '{rank.OWNER_NOTE}' AS note FROM (SELECT path, band, s AS top_active_share, CASE WHEN band = 'red' AND s < 0.1 THEN 'high' WHEN band = 'red' AND s < 0.3 OR band = 'yellow' AND s < 0.1 THEN 'elevated' END AS risk
 FROM (SELECT path, {_BAND} AS band, coalesce(top_active_share, 0) AS s FROM rk LEFT JOIN tas USING (path)) WHERE band <> 'green') WHERE risk IS NOT NULL""",
        {**HEALTH, **KNOWLEDGE},
    ),
    "finding_hotspot_overlap": with_facts(
        f"""SELECT path, findings, hotspot_score, 1 AS engines, 'warning' AS worst_level, rp AS revs_percentile, health_band, CASE WHEN rp >= 0.9 AND health_band = 'red' THEN 'act-now' WHEN rp >= 0.7 OR health_band = 'red' THEN 'plan' ELSE 'note' END AS priority
 FROM (SELECT path, findings, round(coalesce(r, 0), 9) AS rp, health_band FROM (SELECT path, count(*) AS findings FROM ln WHERE contains(line, 'TODO') GROUP BY 1)
 LEFT JOIN (SELECT path, percent_rank() OVER (ORDER BY n_revs) AS r FROM pr) USING (path) LEFT JOIN (SELECT path, {_BAND} AS health_band FROM rk) USING (path)) LEFT JOIN (SELECT path, hotspot_score FROM hs) USING (path)""",
        {**HEALTH, **_hot(_REVS)},
    ),
}
