"""Registered co-change queries and derived relations with their SQL."""

from __future__ import annotations

from tidemark.operators import churn, coupling, relations
from tidemark.plans.facts_sql import AS_OF, with_facts

_TARGET = "CHANGELOG.md"
_THIN = {"min_coupling_pct": 20.0, "min_shared_revs": 3}

ANALYSES = {
    "coupling": (coupling.rounded, _THIN),
    "coupling_fdr": (coupling.rounded, {**_THIN, "fdr_correction": True}),
    "coupling_compat": (coupling.rounded, {**_THIN, "compat": True}),
    "coupling_by_day": (coupling.rounded, {**_THIN, "time_bucket": "day"}),
    "partner_index": (coupling.partners, _THIN),
    "coupling_absences": (coupling.coupling_absences_of_latest, _THIN),
    "coupling_density": (coupling.coupling_density, _THIN),
    "coupling_degree": (coupling.coupling_degree, _THIN),
    "clone_coupling": (coupling.clone_coupling, {"min_clone_node_count": 10, "min_coupling_pct": 0.0, "min_clone_shared_revs": 1, "min_revs": 2, "significance": 0.9}),
    "bucketed_changes": (relations.bucketed_changes, {"time_bucket": "week"}),
    "lineage_revisions": (relations.lineage_revisions, {"min_revs": 1}),
    "revisions_by_lineage": (churn.revisions, {"min_revs": 1, "lineage": True}),
    "grouped_changes": (relations.grouped, {}),
    "sampled_commits": (relations.sampled, {}),
}

_LGAMMA = "lgamma(ra + 1) + lgamma(n - ra + 1) + lgamma(rb + 1) + lgamma(n - rb + 1) - lgamma(n + 1)"


def coupling_ctes(min_revs: int = 5, shared: int = 3, low: float = 20, compat: bool = False, rows: str = "SELECT rev, path FROM ch", good: str = "SELECT rev FROM ch GROUP BY 1 HAVING count(*) <= 30") -> dict[str, str]:
    """Pairs with degree and exact p as SQL relations; the result is ``cp``."""
    return {
        "src": rows,
        "gd": good,
        "gr": "SELECT src.* FROM src JOIN gd USING (rev)",
        "rv": "SELECT path, count(*) AS revs FROM gr GROUP BY 1" + ("" if compat else f" HAVING count(*) >= {min_revs}"),
        "kp": "SELECT gr.* FROM gr JOIN rv USING (path)",
        "pa_": f"SELECT x.path AS entity_a, y.path AS entity_b, count(*) AS shared FROM kp x JOIN kp y ON x.rev = y.rev AND x.path < y.path GROUP BY 1, 2 HAVING count(*) >= {shared}",
        "dg": f"""SELECT * FROM (SELECT pa_.*, a.revs AS ra, b.revs AS rb, 200.0::DOUBLE * shared / (a.revs + b.revs) AS degree, (SELECT count(DISTINCT rev) FROM gr) AS n
 FROM pa_ JOIN rv a ON a.path = entity_a JOIN rv b ON b.path = entity_b) WHERE degree >= {low} AND degree <= 100""",
        "un": "SELECT DISTINCT shared, ra, rb, n FROM dg",
        "lp": f"""SELECT shared, ra, rb, n, k, {_LGAMMA} - lgamma(k + 1) - lgamma(ra - k + 1) - lgamma(rb - k + 1) - lgamma(n - ra - rb + k + 1) AS lp
 FROM (SELECT *, unnest(range(greatest(0, ra + rb - n), least(ra, rb) + 1)) AS k FROM un WHERE ra > 0 AND rb > 0 AND ra < n AND rb < n AND n - ra - rb + shared >= 0)""",
        "fp": """SELECT shared, ra, rb, n, least(1.0, sum(exp(lp))) AS p FROM (SELECT *, max(CASE WHEN k = shared THEN lp END) OVER (PARTITION BY shared, ra, rb, n) AS obs FROM lp) WHERE lp <= obs + 1e-9 GROUP BY 1, 2, 3, 4""",
        "al_": "SELECT dg.*, fp.p FROM dg LEFT JOIN fp USING (shared, ra, rb, n)",
        "cp": "SELECT * FROM al_" if compat else "SELECT * FROM al_ WHERE p < 0.05",
        "ix": "SELECT entity_a AS path, entity_b AS partner, degree FROM cp UNION ALL SELECT entity_b, entity_a, degree FROM cp",
    }


_OUT = "SELECT entity_a, entity_b, shared, ra AS revs_a, rb AS revs_b, {avg} AS average_revs, round(degree, 6) AS degree, round(p, 7) AS fisher_p FROM {src}"
_FLOOR = "(ra + rb) // 2"


def islands_ctes(min_revs: int = 5) -> dict[str, str]:
    """Paths whose main author has left as a SQL relation, ``isl``."""
    return {
        "hb_": f"SELECT * FROM hc WHERE date <= {AS_OF}",
        "il_": "SELECT path, hb_.canonical_author AS a, sum(loc_added)::BIGINT AS loc FROM ch JOIN hb_ USING (rev) GROUP BY 1, 2",
        "im_": "SELECT path, first(a ORDER BY loc DESC, a) AS main FROM il_ GROUP BY 1 HAVING sum(loc) > 0",
        "isl": f"""SELECT path AS entity FROM im_ JOIN (SELECT canonical_author AS main, max(date) AS last_at FROM hb_ GROUP BY 1) USING (main) WHERE date_diff('day', last_at, {AS_OF}) > 90
 AND path IN (SELECT path FROM (SELECT path, arg_max(change_type, ROW(date, -seq)) AS latest, count(*) AS n FROM dc WHERE date <= {AS_OF} GROUP BY 1) WHERE latest <> 'deleted' AND n >= {min_revs})""",
    }


SQL = {
    "coupling": with_facts(_OUT.format(avg=_FLOOR, src="cp"), coupling_ctes()),
    "coupling_fdr": with_facts(
        _OUT.format(avg=_FLOOR, src="al_")
        + """ WHERE p <= (SELECT max(p) FROM (SELECT p, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM al_ WHERE p IS NOT NULL) WHERE p <= k / m::DOUBLE * 0.05::DOUBLE)""",
        coupling_ctes(),
    ),
    "coupling_compat": with_facts(_OUT.format(avg="(ra + rb + 1) // 2", src="cp") + " WHERE (ra + rb + 1) // 2 >= 5", coupling_ctes(compat=True)),
    "coupling_by_day": with_facts(
        _OUT.format(avg=_FLOOR, src="cp"),
        coupling_ctes(
            rows="SELECT DISTINCT strftime(date, '%Y-%m-%d') AS rev, path FROM dc",
            good="SELECT strftime(date, '%Y-%m-%d') AS rev FROM (SELECT rev AS r, count(*) AS n FROM ch GROUP BY 1) x JOIN c ON c.rev = x.r GROUP BY 1 HAVING max(n) <= 30",
        ),
    ),
    "partner_index": with_facts("SELECT path, partner, round(degree, 6) AS degree FROM ix", coupling_ctes()),
    "coupling_absences": with_facts(
        "SELECT path AS touched_file, partner AS expected_partner, round(degree, 6) AS degree FROM ix WHERE path IN (SELECT path FROM tch) AND partner NOT IN (SELECT path FROM tch)",
        {**coupling_ctes(), "tch": "SELECT DISTINCT path FROM dc WHERE seq < 100"},
    ),
    "coupling_density": with_facts(
        """SELECT nodes, edges, round(CASE WHEN nodes > 1 THEN least(1.0, edges / (nodes * (nodes - 1) / 2.0::DOUBLE)) ELSE 0 END, 9) AS density
 FROM (SELECT (SELECT count(DISTINCT path) FROM ix) AS nodes, (SELECT count(*) FROM cp) AS edges)""",
        coupling_ctes(),
    ),
    "coupling_degree": with_facts("SELECT path, count(*) AS degree, round(sum(degree), 6) AS weighted_degree FROM ix GROUP BY 1", coupling_ctes()),
    "clone_coupling": with_facts(
        f"""SELECT entity_a IN (SELECT entity FROM isl) OR entity_b IN (SELECT entity FROM isl) AS at_risk, round(p, 7) AS p_value, a.fingerprint, entity_a AS file_a, entity_b AS file_b, a.node_count, 1.0::DOUBLE AS similarity, shared AS shared_revs, ra AS support_a, rb AS support_b, round(degree, 6) AS degree_pct,
 round(degree / 100 * (1 - p), 6) AS combined_score FROM al_ JOIN mem a ON a.path = entity_a JOIN mem b ON b.path = entity_b AND b.fingerprint = a.fingerprint
 WHERE p < 0.9 AND regexp_extract(entity_a, '^(.*)/[^/]*$', 1) <> regexp_extract(entity_b, '^(.*)/[^/]*$', 1)""",
        {**coupling_ctes(min_revs=2, shared=1, low=0), **islands_ctes(2), "mem": "SELECT fingerprint, path, max(node_count) AS node_count FROM cl WHERE node_count >= 10 GROUP BY 1, 2"},
    ),
    "bucketed_changes": with_facts(
        "SELECT strftime(date_trunc('week', date), '%Y-%m-%d') AS rev, path, sum(loc_added)::BIGINT AS loc_added, sum(loc_deleted)::BIGINT AS loc_deleted, arg_max(change_type, ROW(date, -seq)) AS change_type FROM dc GROUP BY 1, 2"
    ),
    "lineage_revisions": with_facts(
        """SELECT path, count(*) AS n_revs FROM (SELECT DISTINCT dc.rev, coalesce(fin.canonical, dc.path) AS path FROM dc LEFT JOIN fin ON fin.path = dc.path AND ROW(dc.date, -dc.seq) < fin.until
 AND (fin.since IS NULL OR ROW(dc.date, -dc.seq) >= fin.since)) GROUP BY 1""",
        {
            "st": """SELECT src, tm, min(dst) AS dst FROM (SELECT rename_from AS src, path AS dst, ROW(date, -seq) AS tm FROM dc
 WHERE change_type = 'renamed' AND rename_from <> '' AND rename_from <> path) GROUP BY 1, 2""",
            "nx": "SELECT src, tm, dst, lag(tm) OVER (PARTITION BY src ORDER BY tm) AS since FROM st",
            "wk": """SELECT src AS path, since, tm AS until, dst AS canonical, tm AS reached, 1 AS depth FROM nx
 UNION ALL SELECT wk.path, wk.since, wk.until, o.dst, o.tm, wk.depth + 1 FROM wk JOIN nx o ON o.src = wk.canonical AND o.tm > wk.reached AND (o.since IS NULL OR o.since <= wk.reached) WHERE wk.depth < 50""",
            "fin": "SELECT * FROM (SELECT path, since, until, arg_max(canonical, depth) AS canonical FROM wk GROUP BY 1, 2, 3) WHERE path <> canonical",
        },
        recursive=True,
    ).replace("wk AS MATERIALIZED", "wk AS"),
    "grouped_changes": with_facts(
        """SELECT rev, grp AS path, sum(loc_added)::BIGINT AS loc_added, sum(loc_deleted)::BIGINT AS loc_deleted, max(change_type) AS change_type FROM (
 SELECT *, CASE WHEN path LIKE 'apps/%' OR path = 'apps' THEN 'applications' WHEN regexp_matches(path, '^(libs|packages)/') THEN 'libraries' WHEN regexp_matches(path, '^tools/[a-m]') THEN 'tools a-m' END AS grp FROM ch)
 WHERE grp IS NOT NULL GROUP BY 1, 2"""
    ),
    "sampled_commits": with_facts(
        """SELECT min(k)::BIGINT AS k, rev, strftime(any_value(date), '%Y-%m-%d') AS date FROM (SELECT rev, date, row_number() OVER (ORDER BY date, seq DESC) - 1 AS place, count(*) OVER () AS total FROM c) x
 JOIN (SELECT unnest(range(0, 12)) AS k) s ON place = (k * (total - 1)) // 11 GROUP BY 2"""
    ),
}
SQL["revisions_by_lineage"] = SQL["lineage_revisions"]
