"""Registered ownership, knowledge and team queries with their SQL."""

from __future__ import annotations

from tidemark.operators import ownership as own
from tidemark.plans.facts_sql import AS_OF, with_facts

ANALYSES = {
    "ownership": (own.ownership, {}),
    "main_dev": (own.main_dev, {}),
    "main_dev_by_revs": (own.main_dev_by_revs, {}),
    "main_dev_by_deletions": (own.main_dev_by_deletions, {}),
    "entity_effort": (own.entity_effort, {}),
    "entity_ownership": (own.entity_ownership, {}),
    "communication": (own.communication, {}),
    "knowledge_islands": (own.knowledge_islands, {}),
    "knowledge_shares": (own.shares, {}),
    "doe_scores": (own.doe_scores, {}),
    "code_familiarity": (own.code_familiarity, {}),
    "team_composition": (own.team_composition, {}),
    "bus_factor": (own.bus_factor, {}),
    "bus_factor_doe": (own.bus_factor_doe, {}),
    "pair_programming": (own.pair_programming, {"min_shared_revs": 2}),
    "owner_activity": (lambda fs: own.owner_activity(fs, fs.files), {}),
    "top_active_share": (own.top_active_share, {}),
}

_MAIN = """SELECT entity, main_dev, metric, total, round(metric::DOUBLE / greatest(total, 1), 2) AS ownership FROM (
 SELECT path AS entity, first(a ORDER BY m DESC, a) AS main_dev, max(m) AS metric, sum(m)::BIGINT AS total, sum(n) AS revs FROM (
 SELECT path, canonical_author AS a, sum({m})::BIGINT AS m, count(*) AS n FROM dc GROUP BY 1, 2) GROUP BY 1) WHERE revs >= 5"""
_MODULE = "CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '<root>' END"

#: Relations that several of these queries, and later ones, build on.
KNOWLEDGE = {
    "hl": "SELECT dc.* FROM dc JOIN hc ON hc.rev = dc.rev",
    "ksw": f"""SELECT hl.path, hl.rev, hl.canonical_author AS author, loc_added * CASE ai_attribution WHEN 'ai-authored' THEN 0.3::DOUBLE WHEN 'ai-assisted' THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END
 * exp(-greatest(date_diff('day', hl.date, {AS_OF}), 0) / 220.0::DOUBLE) AS k FROM hl JOIN live ON live.path = hl.path WHERE change_type <> 'deleted'""",
    "ppl": "SELECT lower(raw_email) AS email, min(canonical) AS author FROM al WHERE NOT is_bot GROUP BY 1",
    "crd": r"""SELECT DISTINCT t.rev, ppl.author FROM (SELECT DISTINCT rev, canonical_author AS writer, regexp_extract(line, '<([^>]+)>', 1) AS email FROM (
 SELECT rev, canonical_author, unnest(string_split(lower(message), chr(10))) AS line FROM hc WHERE nf <= 10) WHERE regexp_matches(line, '^\s*(co-authored-by|reviewed-by):')) t
 JOIN ppl ON ppl.email = t.email WHERE ppl.author <> t.writer""",
    "ks": """SELECT path, author, k, CASE WHEN sum(k) OVER (PARTITION BY path) > 0 THEN k / sum(k) OVER (PARTITION BY path) END AS k_norm FROM (
 SELECT path, author, sum(k) AS k FROM (SELECT path, author, k FROM ksw UNION ALL SELECT ksw.path, crd.author, ksw.k * 0.5::DOUBLE FROM ksw JOIN crd ON crd.rev = ksw.rev) GROUP BY 1, 2)""",
    "act": f"SELECT DISTINCT canonical_author AS author FROM hc WHERE date >= {AS_OF} - INTERVAL 90 DAYS AND date <= {AS_OF}",
    "doe": f"""SELECT path, author, doe, doe >= 1 AND doe >= 0.75::DOUBLE * max(doe) OVER (PARTITION BY path) AS is_expert FROM (
 SELECT p.path, author, round(5.28223::DOUBLE + 0.23173::DOUBLE * ln((1 + adds)::DOUBLE) + 0.36151::DOUBLE * created - 0.19421::DOUBLE * ln((1 + greatest(date_diff('day', last_at, {AS_OF}), 0))::DOUBLE)
 - 0.28761::DOUBLE * ln(greatest(sloc, 1)::DOUBLE), 9) AS doe FROM (
 SELECT hl.path, canonical_author AS author, sum(loc_added)::BIGINT AS adds, max(CASE WHEN change_type = 'added' THEN 1 ELSE 0 END) AS created, max(date) AS last_at
 FROM hl JOIN live ON live.path = hl.path WHERE change_type <> 'deleted' GROUP BY 1, 2) p JOIN f ON f.path = p.path)""",
    "tas": "SELECT path, round(coalesce(max(CASE WHEN author IN (SELECT author FROM act) THEN k_norm END), 0), 9) AS top_active_share FROM ks GROUP BY 1",
}

SQL = {
    "ownership": with_facts(
        """SELECT path, first(a ORDER BY n DESC, a) AS main_author, sum(n)::BIGINT AS total_revs, 1 - sum(n * n)::DOUBLE / (sum(n)::DOUBLE * sum(n)::DOUBLE) AS fractal_value
 FROM (SELECT path, canonical_author AS a, count(*) AS n FROM dc GROUP BY 1, 2) GROUP BY 1 HAVING sum(n) >= 5"""
    ),
    "main_dev": with_facts(_MAIN.format(m="loc_added")),
    "main_dev_by_revs": with_facts(_MAIN.format(m="1")),
    "main_dev_by_deletions": with_facts(_MAIN.format(m="loc_deleted")),
    "entity_effort": with_facts(
        "SELECT path AS entity, canonical_author AS author, count(*) AS author_revs, sum(count(*)) OVER (PARTITION BY path)::BIGINT AS total_revs FROM dc GROUP BY 1, 2"
    ),
    "entity_ownership": with_facts("SELECT path AS entity, canonical_author AS author, sum(loc_added)::BIGINT AS added, sum(loc_deleted)::BIGINT AS deleted FROM dc GROUP BY 1, 2"),
    "communication": with_facts(
        """SELECT author_a, author_b, shared, (x.n + y.n) // 2 AS average, 200.0::DOUBLE * shared / (x.n + y.n) AS strength FROM (
 SELECT p.a AS author_a, q.a AS author_b, count(*) AS shared FROM pa_ p JOIN pa_ q ON p.path = q.path AND p.a < q.a GROUP BY 1, 2 HAVING count(*) >= 5)
 JOIN tot x ON x.a = author_a JOIN tot y ON y.a = author_b""",
        {"pa_": "SELECT DISTINCT path, hc.canonical_author AS a FROM ch JOIN hc USING (rev)", "tot": "SELECT canonical_author AS a, count(*) AS n FROM hc GROUP BY 1"},
    ),
    "knowledge_islands": with_facts(
        f"""SELECT entity, main_author, ownership_pct, date_diff('day', last_at, {AS_OF})::BIGINT AS days_since_main_active, strftime(last_at, '%Y-%m-%d') AS last_main_author_commit,
 n_substantial_others, total_loc FROM (
 SELECT path AS entity, first(a ORDER BY loc DESC, a) AS main_author, max(share) * 100 AS ownership_pct, count(*) FILTER (share >= 0.1) - CASE WHEN max(share) >= 0.1 THEN 1 ELSE 0 END AS n_substantial_others,
 max(total) AS total_loc FROM (SELECT *, loc / total::DOUBLE AS share FROM (SELECT path, a, loc, sum(loc) OVER (PARTITION BY path)::BIGINT AS total FROM pl_) WHERE total > 0) GROUP BY 1)
 JOIN (SELECT canonical_author AS main_author, max(date) AS last_at FROM hb GROUP BY 1) USING (main_author)
 WHERE date_diff('day', last_at, {AS_OF}) > 90
 AND entity IN (SELECT path FROM (SELECT path, arg_max(change_type, ROW(date, -seq)) AS latest, count(*) AS n FROM dc WHERE date <= {AS_OF} GROUP BY 1) WHERE latest <> 'deleted' AND n >= 5)""",
        {
            "hb": f"SELECT * FROM hc WHERE date <= {AS_OF}",
            "pl_": "SELECT path, hb.canonical_author AS a, sum(loc_added)::BIGINT AS loc FROM ch JOIN hb USING (rev) GROUP BY 1, 2",
        },
    ),
    "knowledge_shares": with_facts("SELECT path, author, round(k, 6) AS k, round(k_norm, 6) AS k_norm FROM ks", KNOWLEDGE),
    "doe_scores": with_facts("SELECT * FROM doe", KNOWLEDGE),
    "code_familiarity": with_facts(
        """SELECT 'repository' AS scope, familiarity_pct, (SELECT count(*) FROM act) AS active_authors, (SELECT count(DISTINCT canonical_author) FROM hc) AS total_authors, islands_pct,
 CASE WHEN familiarity_pct >= 70 THEN 'good' ELSE 'risky' END AS verdict FROM (
 SELECT round(100 * sum(sloc * coalesce(fam, 0)) / sum(sloc), 6) AS familiarity_pct, round(100.0::DOUBLE * count(*) FILTER (top >= 0.8 AND big < 2) / count(*), 6) AS islands_pct FROM f JOIN live USING (path) LEFT JOIN (
 SELECT path, sum(CASE WHEN author IN (SELECT author FROM act) THEN k_norm ELSE 0 END) AS fam, max(round(k_norm, 9)) AS top, count(*) FILTER (k_norm >= 0.2) AS big FROM ks GROUP BY 1) USING (path))""",
        KNOWLEDGE,
    ),
    "team_composition": with_facts(
        f"""SELECT author, round(td, 6) AS tenure_days, CASE WHEN td >= 365 AND files_touched >= cb THEN 'veteran' WHEN td >= 90 THEN 'experienced' ELSE 'onboarded' END AS bucket, files_touched >= cb AS veteran_breadth_ok,
 last_at >= {AS_OF} - INTERVAL 90 DAYS AS active, commits, files_touched, is_core FROM (
 SELECT *, (epoch_us(last_at) - epoch_us(first_at)) / 86400000000.0::DOUBLE AS td, (SELECT quantile_cont(files_touched, 0.5) FROM core WHERE is_core) AS cb FROM core)""",
        {
            "hb": f"SELECT * FROM hc WHERE date <= {AS_OF}",
            "per": """SELECT author, commits, first_at, last_at, coalesce(ft, 0) AS files_touched FROM (SELECT canonical_author AS author, count(*) AS commits, min(date) AS first_at, max(date) AS last_at FROM hb GROUP BY 1)
 LEFT JOIN (SELECT hb.canonical_author AS author, count(DISTINCT path) AS ft FROM ch JOIN hb USING (rev) GROUP BY 1) USING (author)""",
            "core": "SELECT *, (SELECT coalesce(sum(q.commits), 0) FROM per q WHERE q.commits > per.commits) < 0.8::DOUBLE * (SELECT sum(commits) FROM per) AS is_core FROM per",
        },
    ),
    "bus_factor": with_facts(
        f"""SELECT module, max(total)::BIGINT AS total_commits, min(CASE WHEN upto >= 0.8::DOUBLE * total THEN rk END) AS bus_factor, first(a ORDER BY rk) AS top_contributor,
 round(max(n) / max(total)::DOUBLE, 6) AS top_contributor_share, 'commits' AS model FROM (
 SELECT module, a, n, row_number() OVER w AS rk, sum(n) OVER (PARTITION BY module ORDER BY n DESC, a ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY module) AS total FROM (
 SELECT module, hc.canonical_author AS a, count(*) AS n FROM (SELECT DISTINCT rev, {_MODULE} AS module FROM ch) m JOIN hc USING (rev) WHERE NOT is_merge GROUP BY 1, 2)
 WINDOW w AS (PARTITION BY module ORDER BY n DESC, a)) GROUP BY 1"""
    ),
    "pair_programming": with_facts(
        """SELECT p.email AS author_a, q.email AS author_b, count(*) AS pair_commits FROM pp p JOIN pp q ON p.rev = q.rev AND p.email < q.email GROUP BY 1, 2 HAVING count(*) >= 2""",
        {
            "pp": r"""SELECT DISTINCT rev, email FROM (SELECT rev, lower(author_email) AS email FROM c WHERE NOT is_merge AND author_email IS NOT NULL UNION ALL
 SELECT rev, regexp_extract(line, '<([^>]+)>', 1) FROM (SELECT rev, unnest(string_split(lower(message), chr(10))) AS line FROM c WHERE NOT is_merge AND author_email IS NOT NULL)
 WHERE regexp_matches(line, '^\s*co-authored-by:') AND regexp_extract(line, '<([^>]+)>', 1) <> '') WHERE email NOT IN (SELECT lower(raw_email) FROM al WHERE is_bot AND raw_email IS NOT NULL)"""
        },
    ),
    "owner_activity": with_facts(
        f"""SELECT path, main_author, date_diff('day', last_at, {AS_OF})::BIGINT AS days_since_main_active FROM (
 SELECT path, first(a ORDER BY loc DESC, a) AS main_author FROM (SELECT path, canonical_author AS a, sum(loc_added) AS loc FROM hl WHERE path IN (SELECT path FROM f) GROUP BY 1, 2) GROUP BY 1)
 JOIN (SELECT canonical_author AS main_author, max(date) AS last_at FROM hc GROUP BY 1) USING (main_author)""",
        KNOWLEDGE,
    ),
    "top_active_share": with_facts("SELECT * FROM tas", KNOWLEDGE),
}
