"""Registered counting, churn and age queries with their SQL."""

from __future__ import annotations

from tidemark.operators import churn
from tidemark.plans.facts_sql import AS_OF, with_facts

ANALYSES = {
    "summary": (churn.summary, {}),
    "summary_compat": (churn.summary, {"compat": True}),
    "revisions": (churn.revisions, {}),
    "authors": (churn.authors, {}),
    "top_committers": (churn.top_committers, {}),
    "abs_churn": (churn.abs_churn, {}),
    "author_churn": (churn.author_churn, {}),
    "entity_churn": (churn.entity_churn, {}),
    "code_age": (churn.code_age, {}),
    "stale_code": (churn.stale_code, {}),
    "messages": (churn.messages, {"expression": "(?i)re-?index|simplify"}),
    "soc": (churn.soc, {}),
    "hotspot_velocity": (churn.hotspot_velocity, {"min_revs": 3}),
    "live_paths": (churn.live_paths, {}),
    "live_paths_at": (churn.live_paths_at, {}),
}

_SUMMARY = """SELECT 'commits' AS metric, count(*)::BIGINT AS value FROM c UNION ALL SELECT 'entities', count(DISTINCT path) FROM ch
UNION ALL SELECT 'changes', count(*) FROM ch UNION ALL SELECT 'authors', count(DISTINCT canonical_author) FROM {people}"""
_CHURN = """SELECT {key}, sum(added)::BIGINT AS added, sum(deleted)::BIGINT AS deleted, count(*) AS commits FROM (
 SELECT rev, sum(loc_added) AS added, sum(loc_deleted) AS deleted FROM ch GROUP BY 1) x JOIN c USING (rev) GROUP BY 1"""
_MONTHS = "((year({a}) - year({b})) * 12 + month({a}) - month({b}) - CASE WHEN day({a}) < day({b}) THEN 1 ELSE 0 END)::BIGINT"
_END = f"({AS_OF} + INTERVAL 86399 SECONDS)"

SQL = {
    "summary": with_facts(_SUMMARY.format(people="hc")),
    "summary_compat": with_facts(_SUMMARY.format(people="c")),
    "revisions": with_facts("SELECT path, n_revs FROM pr WHERE n_revs >= 5"),
    "authors": with_facts(
        """SELECT path AS entity, count(*) AS n_authors, count(*) FILTER (NOT bot) AS n_humans, count(*) FILTER (bot) AS n_bots, sum(n)::BIGINT AS n_revs,
 first(canonical_author ORDER BY last_at DESC, canonical_author) AS last_author, strftime(max(last_at), '%Y-%m-%d') AS last_modified FROM (
 SELECT path, canonical_author, count(*) AS n, max(date) AS last_at,
 count(*) FILTER (ai_attribution = 'ai-authored') = count(*) OR canonical_author NOT IN (SELECT canonical_author FROM hc) AS bot FROM dc GROUP BY 1, 2) GROUP BY 1"""
    ),
    "top_committers": with_facts(
        """SELECT canonical_author AS author, count(*) AS commits, coalesce(sum(a), 0)::BIGINT AS loc_added, coalesce(sum(d), 0)::BIGINT AS loc_deleted,
 strftime(min(date), '%Y-%m-%d') AS first_commit, strftime(max(date), '%Y-%m-%d') AS last_commit, canonical_author NOT IN (SELECT canonical_author FROM hc) AS is_bot
 FROM c LEFT JOIN (SELECT rev, sum(loc_added) AS a, sum(loc_deleted) AS d FROM ch GROUP BY 1) USING (rev) GROUP BY 1"""
    ),
    "abs_churn": with_facts(_CHURN.format(key="strftime(date, '%Y-%m-%d') AS date")),
    "author_churn": with_facts(_CHURN.format(key="canonical_author AS author")),
    "entity_churn": with_facts(
        "SELECT path, sum(loc_added)::BIGINT AS added, sum(loc_deleted)::BIGINT AS deleted, count(*) AS commits FROM dc WHERE path IN (SELECT path FROM live) GROUP BY 1 HAVING count(*) >= 5"
    ),
    "code_age": with_facts(
        f"""SELECT path, {_MONTHS.format(a=_END, b="last")} AS age_months, date_diff('day', last, {_END})::BIGINT AS age_days, strftime(last, '%Y-%m-%d') AS last_modified
 FROM (SELECT path, max(date) AS last, arg_max(change_type, ROW(date, -seq)) AS latest FROM dc WHERE date <= {_END} GROUP BY 1) WHERE latest <> 'deleted'"""
    ),
    "stale_code": with_facts(
        f"""SELECT path, strftime(last, '%Y-%m-%d') AS last_touched, m AS months_since_touched, g AS max_cognitive FROM (
 SELECT path, last, {_MONTHS.format(a=AS_OF, b="last")} AS m, coalesce(cognitive, 0) AS g FROM (SELECT path, max(date) AS last FROM dc GROUP BY 1) JOIN live USING (path) LEFT JOIN f USING (path))
 WHERE m >= 12 AND g <= 5"""
    ),
    "messages": with_facts("SELECT path AS entity, count(*) AS matches FROM ch JOIN c USING (rev) WHERE regexp_matches(message, '(?i)re-?index|simplify') GROUP BY 1"),
    "soc": with_facts(
        "SELECT path AS entity, sum(n - 1)::BIGINT AS soc FROM ch JOIN (SELECT rev, count(*) AS n FROM ch GROUP BY 1 HAVING count(*) <= 30) USING (rev) GROUP BY 1 HAVING sum(n - 1) >= 1"
    ),
    "hotspot_velocity": with_facts(
        f"""SELECT path, r AS revs_recent, b AS revs_baseline, r * 7 / 30.0::DOUBLE AS recent_per_week, b * 7 / 90.0::DOUBLE AS baseline_per_week, r * 7 / 30.0::DOUBLE - b * 7 / 90.0::DOUBLE AS acceleration
 FROM (SELECT path, count(*) FILTER (date > {AS_OF} - INTERVAL 30 DAYS) AS r, count(*) FILTER (date <= {AS_OF} - INTERVAL 30 DAYS) AS b FROM dc
 WHERE date > {AS_OF} - INTERVAL 120 DAYS AND date <= {AS_OF} GROUP BY 1) WHERE r >= 1 AND r + b >= 3"""
    ),
    "live_paths": with_facts("SELECT path FROM live"),
    "live_paths_at": with_facts(
        f"""SELECT path FROM (SELECT path, arg_max(change_type, ROW(date, -seq)) AS latest, max(date) AS seen FROM dc WHERE date <= {AS_OF} GROUP BY 1) s
 LEFT JOIN (SELECT rename_from, max(date) AS gone FROM dc WHERE change_type = 'renamed' AND rename_from <> '' AND date <= {AS_OF} GROUP BY 1) g ON g.rename_from = s.path
 WHERE latest <> 'deleted' AND NOT coalesce(gone > seen, false)"""
    ),
}
