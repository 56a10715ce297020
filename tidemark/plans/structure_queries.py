"""Registered structure queries with their SQL."""

from __future__ import annotations

from tidemark.operators import structure as s
from tidemark.plans.coupling_queries import coupling_ctes
from tidemark.plans.facts_sql import with_facts

_THIN = {"min_coupling_pct": 20.0, "min_shared_revs": 3}
_LOOSE = {"min_coupling_pct": 0.0, "min_shared_revs": 1, "min_revs": 2, "significance": 0.9}

ANALYSES = {
    "dependency_reach": (s.reach, {}),
    "dependency_cycles": (s.dependency_cycles, {}),
    "architecture_roles": (s.architecture_roles, {}),
    "dependency_levels": (s.dependency_levels, {}),
    "instability": (s.instability, {}),
    "architecture_metrics": (s.architecture_metrics, {}),
    "architecture_trend": (s.architecture_trend, {}),
    "health_trend": (s.health_trend, {}),
    "cycle_origins": (s.cycle_origins, {}),
    "cycle_health": (s.cycle_health, {}),
    "modularity_violations": (s.modularity_violations, _THIN),
    "unstable_interface": (s.unstable_interface, _LOOSE),
    "crossing": (lambda fs: s.crossing(fs, 1), _LOOSE),
    "architecture_violations": (s.architecture_violations, _THIN),
    "centrality": (s.centrality, _THIN),
    "communities": (s.communities, _THIN),
    "modularity": (s.modularity, _THIN),
    "connected_parts": (s.connected_parts, _THIN),
}

REACH = {
    "rc_": "SELECT src_path AS src, target_path AS dst FROM ie UNION SELECT rc_.src, ie.target_path FROM rc_ JOIN ie ON ie.src_path = rc_.dst",
    "cm": "SELECT a.src AS path, least(a.src, min(a.dst)) AS component FROM rc_ a JOIN rc_ b ON a.src = b.dst AND a.dst = b.src GROUP BY 1",
    "vi": """SELECT f.path, 1 + coalesce(i.n, 0) AS vfi, 1 + coalesce(o.n, 0) AS vfo, cm.component FROM f LEFT JOIN (SELECT dst AS path, count(*) AS n FROM rc_ WHERE src <> dst GROUP BY 1) i ON i.path = f.path
 LEFT JOIN (SELECT src AS path, count(*) AS n FROM rc_ WHERE src <> dst GROUP BY 1) o ON o.path = f.path LEFT JOIN cm ON cm.path = f.path""",
    "cy": "SELECT row_number() OVER (ORDER BY size DESC, component) AS cycle_id, size, component FROM (SELECT component, count(*) AS size FROM cm GROUP BY 1 HAVING count(*) >= 2)",
}


def _reach(body: str, own: dict[str, str] | None = None) -> str:
    return with_facts(body, {**REACH, **(own or {})}, recursive=True).replace("rc_ AS MATERIALIZED", "rc_ AS").replace("lv AS MATERIALIZED", "lv AS")


_LOOSE_CTES = coupling_ctes(min_revs=2, shared=1, low=0)
_LOOSE_CTES["cp"] = "SELECT * FROM al_ WHERE p < 0.9"
_NEIGHBOURS = {
    **_LOOSE_CTES,
    "up": "SELECT target_path AS path, count(*) AS n FROM ie JOIN ix ON ix.path = ie.target_path AND ix.partner = ie.src_path GROUP BY 1",
    "dn": "SELECT src_path AS path, count(*) AS n FROM ie JOIN ix ON ix.path = ie.src_path AND ix.partner = ie.target_path GROUP BY 1",
}
_LAYER = "CASE WHEN split_part({p}, '/', 1) IN ('apps', 'services') THEN 'front' WHEN split_part({p}, '/', 1) IN ('libs', 'packages', 'crates') THEN 'shared' WHEN split_part({p}, '/', 1) IN ('tools', 'plugins') THEN 'tooling' END"

LEVELS = {
            "nd": "SELECT f.path, coalesce(cm.component, f.path) AS node FROM f LEFT JOIN cm ON cm.path = f.path",
            "ce": "SELECT DISTINCT a.node AS src, b.node AS dst FROM ie JOIN nd a ON a.path = ie.src_path JOIN nd b ON b.path = ie.target_path WHERE a.node <> b.node",
            "lv": "SELECT src AS node, 1 AS level FROM ce UNION SELECT ce.src, lv.level + 1 FROM lv JOIN ce ON ce.dst = lv.node",
            "lvl": "SELECT nd.path, coalesce(max(lv.level), 0)::BIGINT AS level FROM nd LEFT JOIN lv ON lv.node = nd.node GROUP BY 1",
}

SQL = {
    "dependency_reach": _reach("SELECT src, dst FROM rc_"),
    "dependency_cycles": _reach("SELECT cycle_id, size, path FROM cm JOIN cy USING (component)"),
    "architecture_roles": _reach(
        """SELECT path, CASE WHEN component = cid THEN 'core' WHEN vfi >= ri AND vfo < ro THEN 'shared' WHEN vfi < ri AND vfo >= ro THEN 'control' ELSE 'periphery' END AS role, vfi, vfo, component IS NOT NULL AS in_cycle, level,
 round(100.0::DOUBLE * vfo / n, 6) AS reach_pct FROM (SELECT vi.*, count(*) OVER () AS n, (SELECT component FROM cy WHERE cycle_id = 1) AS cid,
 coalesce((SELECT max(vfi) FROM vi WHERE component = (SELECT component FROM cy WHERE cycle_id = 1)), (SELECT vfi FROM vi ORDER BY vfi LIMIT 1 OFFSET (SELECT count(*) // 2 FROM vi))) AS ri,
 coalesce((SELECT max(vfo) FROM vi WHERE component = (SELECT component FROM cy WHERE cycle_id = 1)), (SELECT vfo FROM vi ORDER BY vfo LIMIT 1 OFFSET (SELECT count(*) // 2 FROM vi))) AS ro FROM vi) JOIN lvl USING (path)""",
        LEVELS,
    ),
    "dependency_levels": _reach("SELECT path, level FROM lvl", LEVELS),
    "instability": with_facts(
        """SELECT f.path, coalesce(i.n, 0) AS ca, coalesce(o.n, 0) AS ce, coalesce(round(coalesce(o.n, 0) / nullif(coalesce(i.n, 0) + coalesce(o.n, 0), 0)::DOUBLE, 9), 0) AS instability FROM f
 LEFT JOIN (SELECT target_path AS path, count(*) AS n FROM ie GROUP BY 1) i ON i.path = f.path LEFT JOIN (SELECT src_path AS path, count(*) AS n FROM ie GROUP BY 1) o ON o.path = f.path"""
    ),
    "architecture_metrics": _reach(
        """SELECT unnest(['files', 'propagation_cost', 'average_dependency', 'normalised_dependency', 'cycles', 'largest_cycle', 'type', 'import_resolution']) AS metric,
 unnest([n::VARCHAR, printf('%.4f', round(ccd / (n::DOUBLE * n), 4)), printf('%.4f', round(ccd / n::DOUBLE, 4)), printf('%.4f', round(ccd / ((n + 1) * log2(n + 1::DOUBLE) - n), 4)), cycles::VARCHAR, largest::VARCHAR,
 CASE WHEN cycles = 0 THEN 'hierarchical' WHEN largest >= 0.6 * cyclic THEN 'core-periphery' ELSE 'multi-core' END, printf('%.4f', round(res / imports::DOUBLE, 4))]) AS value
 FROM (SELECT count(*) AS n, sum(vfo)::BIGINT AS ccd, count(component) AS cyclic FROM vi), (SELECT count(*) AS cycles, coalesce(max(size), 0) AS largest FROM cy), (SELECT count(*) AS imports, count(*) FILTER (resolved) AS res FROM im)"""
    ),
    "modularity_violations": _reach(
        """SELECT entity_a, entity_b, shared, round(degree, 6) AS degree, round(p, 7) AS fisher_p FROM cp WHERE NOT EXISTS (SELECT 1 FROM rc_ WHERE src = entity_a AND dst = entity_b) AND NOT EXISTS (SELECT 1 FROM rc_ WHERE src = entity_b AND dst = entity_a)""",
        coupling_ctes(),
    ),
    "unstable_interface": with_facts(
        """SELECT path, fan_in, n_revs AS revisions, up.n AS coupled_dependents, n_revs * up.n AS instability_score FROM (SELECT target_path AS path, count(*) AS fan_in FROM ie GROUP BY 1 HAVING count(*) >= 3)
 JOIN pr USING (path) JOIN up USING (path) WHERE n_revs >= 2""",
        _NEIGHBOURS,
    ),
    "crossing": with_facts(
        """SELECT path, fan_in, fan_out, up.n AS coupled_upstream, dn.n AS coupled_downstream, up.n + dn.n AS crossing_score FROM (SELECT target_path AS path, count(*) AS fan_in FROM ie GROUP BY 1)
 JOIN (SELECT src_path AS path, count(*) AS fan_out FROM ie GROUP BY 1) USING (path) JOIN up USING (path) JOIN dn USING (path)""",
        _NEIGHBOURS,
    ),
    "architecture_violations": with_facts(
        f"""SELECT * FROM (SELECT DISTINCT src_path, target_path, {_LAYER.format(p="src_path")} AS src_layer, {_LAYER.format(p="target_path")} AS target_layer FROM (SELECT * FROM ie UNION ALL SELECT entity_a, entity_b FROM cp))
 WHERE src_layer IS NOT NULL AND target_layer IS NOT NULL AND src_layer <> target_layer AND NOT (src_layer = 'front' AND target_layer = 'shared') AND NOT (src_layer = 'tooling' AND target_layer IN ('shared', 'front'))""",
        coupling_ctes(),
    ),
    "connected_parts": with_facts(
        "SELECT path, min(o) AS part FROM (SELECT path, path AS o FROM ix UNION ALL SELECT path, o FROM wk_) GROUP BY 1",
        {**coupling_ctes(), "wk_": "SELECT path, partner AS o FROM ix UNION SELECT wk_.path, ix.partner FROM wk_ JOIN ix ON ix.path = wk_.o"},
        recursive=True,
    ).replace("wk_ AS MATERIALIZED", "wk_ AS"),
}
