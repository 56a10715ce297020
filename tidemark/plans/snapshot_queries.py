"""Registered comparisons of snapshots, briefings and citation checks with their SQL."""

from __future__ import annotations

from tidemark.operators import snapshots as snap
from tidemark.plans.coupling_queries import coupling_ctes
from tidemark.plans.facts_sql import AS_OF, with_facts

_THIN = {"min_coupling_pct": 20.0, "min_shared_revs": 3}

ANALYSES = {
    "diff_hotspots": (snap.diff_of_year, {}),
    "new_clone_families": (snap.clone_families_of_year, {}),
    "change_set_report": (snap.example_change_set, _THIN),
    "change_context": (snap.context_of_latest, _THIN),
    "gate_citations": (snap.gate_citations, {}),
    "owners_to_brief": (snap.owners_to_brief, {}),
}

_ALIVE = "SELECT path FROM (SELECT path, arg_max(change_type, ROW(date, -seq)) AS latest FROM dc WHERE date <= {at} GROUP BY 1) WHERE latest <> 'deleted'"
_VELOCITY = f"""SELECT path, r * 7 / 30.0::DOUBLE - b * 7 / 90.0::DOUBLE AS acceleration FROM (SELECT path, count(*) FILTER (date > {AS_OF} - INTERVAL 30 DAYS) AS r, count(*) FILTER (date <= {AS_OF} - INTERVAL 30 DAYS) AS b
 FROM dc WHERE date > {AS_OF} - INTERVAL 120 DAYS AND date <= {AS_OF} GROUP BY 1) WHERE r >= 1 AND r + b >= 2"""
_OWNER = "SELECT path, first(a ORDER BY n DESC, a) AS main_author FROM (SELECT path, canonical_author AS a, count(*) AS n FROM dc GROUP BY 1, 2) GROUP BY 1"

SQL = {
    "new_clone_families": with_facts(
        """SELECT fingerprint, coalesce(w.n, 0) AS was, q.n AS now FROM (SELECT fingerprint, count(*) AS n FROM cl WHERE path IN (SELECT path FROM lb) GROUP BY 1) q
 LEFT JOIN (SELECT fingerprint, count(*) AS n FROM cl WHERE path IN (SELECT path FROM la_) GROUP BY 1) w USING (fingerprint) WHERE q.n >= 2 AND coalesce(w.n, 0) < 2""",
        {"la_": _ALIVE.format(at="TIMESTAMP '2025-05-01 00:00:00'"), "lb": _ALIVE.format(at=AS_OF)},
    ),
    "change_context": with_facts(
        f"""SELECT ask.path, coalesce(o.revisions, 0) AS revisions, coalesce(o.window_churn, 0) AS window_churn, ow.main_author, coalesce(pt.partners, '') AS partners FROM ask
 LEFT JOIN (SELECT path, count(*) AS revisions, coalesce(sum(CASE WHEN date >= {AS_OF} - INTERVAL 90 DAYS AND date <= {AS_OF} THEN loc_added + loc_deleted END), 0)::BIGINT AS window_churn FROM dc GROUP BY 1) o ON o.path = ask.path
 LEFT JOIN ow ON ow.path = ask.path LEFT JOIN (SELECT path, string_agg(partner, ', ' ORDER BY k) AS partners FROM (SELECT path, partner, row_number() OVER (PARTITION BY path ORDER BY round(degree, 6) DESC, partner) AS k FROM ix) WHERE k <= 3 GROUP BY 1) pt ON pt.path = ask.path""",
        {**coupling_ctes(), "ask": "SELECT DISTINCT path FROM dc WHERE seq < 10 ORDER BY path LIMIT 20", "ow": _OWNER},
    ),
    "owners_to_brief": with_facts(
        "SELECT main_author, count(*) AS paths, round(sum(acceleration), 6) AS acceleration FROM ve JOIN ow USING (path) GROUP BY 1", {"ve": _VELOCITY, "ow": _OWNER}
    ),
}
