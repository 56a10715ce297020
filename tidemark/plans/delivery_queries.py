"""Registered delivery, general and gate queries with their SQL."""

from __future__ import annotations

from tidemark.operators import delivery as d
from tidemark.operators import gates
from tidemark.sources.readers import ASSISTANT_WORDS, ASSISTANTS, DEFAULT_BOTS
from tidemark.plans.facts_sql import AS_OF, with_facts

ANALYSES = {
    "lead_time": (d.lead_time, {}),
    "mainline": (d.mainline, {}),
    "branch_commits": (d.branch_commits, {}),
    "rework": (d.rework, {}),
    "delivery_metrics": (d.delivery_metrics, {}),
    "release_cadence": (d.release_cadence, {}),
    "release_trend": (d.release_trend, {}),
    "kamei_features": (d.kamei_features, {}),
    "monthly_trends": (d.monthly_trends, {}),
    "control_charts": (d.control_charts, {}),
    "evidence_commits": (d.evidence_commits, {}),
    "new_code": (d.new_code, {}),
    "delta_health": (d.delta_of_halves, {}),
    "ai_classes": (d.ai_classes, {}),
    "scan_coverage": (d.scan_coverage, {}),
    "szz_candidates": (d.szz_candidates, {}),
    "defect_validation": (d.defect_validation, {}),
    "gate_violations": (gates.gate_violations, {}),
    "gate_verdicts": (gates.gate_verdicts, {}),
}

_LINE = {
    "hd": "SELECT arg_max(rev, ROW(date, -seq)) AS rev FROM c",
    "ml": "SELECT rev FROM hd UNION ALL SELECT pa.parent_rev FROM ml JOIN pa ON pa.rev = ml.rev AND pa.position = 0",
    "br": f"""SELECT pa.rev AS merge, pa.parent_rev AS rev, 1 AS depth FROM pa JOIN c m ON m.rev = pa.rev JOIN c x ON x.rev = pa.parent_rev
 WHERE pa.position = 1 AND x.date >= m.date - INTERVAL 90 DAYS AND x.rev NOT IN (SELECT rev FROM ml)
 UNION ALL SELECT br.merge, pa.parent_rev, br.depth + 1 FROM br JOIN pa ON pa.rev = br.rev AND pa.position = 0 JOIN c m ON m.rev = br.merge JOIN c x ON x.rev = pa.parent_rev
 WHERE x.date >= m.date - INTERVAL 90 DAYS AND x.rev NOT IN (SELECT rev FROM ml) AND br.depth < 200""",
    "hd_": "SELECT hk.*, c.date FROM hk JOIN c USING (rev)",
    "wr": f"SELECT * FROM hd_ WHERE date >= {AS_OF} - INTERVAL 90 DAYS AND date <= {AS_OF}",
    "rw": """SELECT coalesce(sum(new_lines), 0)::BIGINT AS written, coalesce(sum(least(o, new_lines)), 0)::BIGINT AS reworked, count(*) AS n FROM wr LEFT JOIN (
 SELECT a.rev, a.path, sum(least(a.new_start + a.new_lines, b.old_start + b.old_lines) - greatest(a.new_start, b.old_start)) AS o FROM wr a JOIN hd_ b ON a.path = b.path AND b.old_lines > 0 AND b.date > a.date
 AND date_diff('day', a.date, b.date) <= 21 AND least(a.new_start + a.new_lines, b.old_start + b.old_lines) > greatest(a.new_start, b.old_start) GROUP BY 1, 2) USING (rev, path)""",
    "sz": "SELECT merge, count(DISTINCT path)::DOUBLE AS files, sum(loc_added + loc_deleted)::DOUBLE AS loc FROM br JOIN ch USING (rev) GROUP BY 1",
    "spn": """SELECT (epoch_us(m.date) // 3600000000 - st // 3600000000)::DOUBLE AS hours FROM (SELECT merge, min(epoch_us(c.date)) AS st FROM br JOIN c ON c.rev = br.rev GROUP BY 1) JOIN c m ON m.rev = merge""",
    "ld_": "SELECT * FROM (SELECT (epoch_us(committer_date) // 3600000000 - epoch_us(date) // 3600000000)::DOUBLE AS hours FROM c WHERE NOT is_merge) WHERE hours > 0",
}


def _line(body: str) -> str:
    return with_facts(body, _LINE, recursive=True).replace("ml AS MATERIALIZED", "ml AS").replace("br AS MATERIALIZED", "br AS")


def _spread(metric: str, value: str, src: str) -> str:
    return f"SELECT '{metric}' AS metric, round(quantile_cont({value}, 0.5), 6) AS p50, round(quantile_cont({value}, 0.75), 6) AS p75, round(quantile_cont({value}, 0.9), 6) AS p90, count(*) AS n FROM {src} HAVING count(*) > 0"


_TOP = "CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '' END"

_CAVEAT = "CASE " + " ".join(f"WHEN metric IN ({', '.join(repr(n) for n in names)}) THEN '{text}'" for text, names in d.CAVEATS.items()).replace(",)", ")") + " END"
_BOT = "(" + " OR ".join(f"contains({{x}}, '{b}')" for b in DEFAULT_BOTS) + ")"
_ASSISTANT = rf"^\s*co-authored-by:\s*({'|'.join(ASSISTANTS)})( +({'|'.join(ASSISTANT_WORDS)}))*\s*(<|$)"

SQL = {
    "lead_time": with_facts(
        """SELECT rev, canonical_author, strftime(date, '%Y-%m-%d') AS author_date, strftime(committer_date, '%Y-%m-%d') AS committer_date, s AS lead_time_seconds, greatest(s, 0) / 86400 AS lead_time_days
 FROM (SELECT *, (epoch_us(committer_date) - epoch_us(date)) / 1e6::DOUBLE AS s FROM c WHERE NOT is_merge)"""
    ),
    "mainline": _line("SELECT rev FROM ml"),
    "branch_commits": _line("SELECT merge, rev FROM br"),
    "rework": with_facts("SELECT * FROM rw", _LINE),
    "delivery_metrics": _line(
        f"SELECT *, {_CAVEAT} AS caveat FROM ("
        + " UNION ALL ".join(
            [
                _spread("batch_size_files", "files", "sz"),
                _spread("batch_size_loc", "loc", "sz"),
                _spread("branch_duration_hours", "hours", "spn"),
                _spread("lead_proxy_hours", "hours", "ld_"),
                "SELECT 'rework_pct', round(100.0::DOUBLE * reworked / nullif(written, 0), 6), NULL, NULL, n FROM rw WHERE n > 0",
                """SELECT 'landed_by_other_pct', round(100.0::DOUBLE * count(*) FILTER (lower(author_email) <> lower(committer_email)) / count(*), 6), NULL, NULL, count(*) FROM c
 WHERE NOT is_merge AND author_email IS NOT NULL AND committer_email IS NOT NULL HAVING count(*) > 0""",
            ]
        )
        + ")"
    ),
    "release_cadence": with_facts("SELECT tag, strftime(date, '%Y-%m-%d') AS date, date_diff('day', lag(date) OVER (ORDER BY date, tag), date)::BIGINT AS days_since_prev FROM tg"),
    "release_trend": with_facts(
        """SELECT n, round(q[2], 6) AS median_days, round(q[3] - q[1], 6) AS iqr_days, round(slope, 9) AS slope, CASE WHEN slope > 0.1::DOUBLE * q[2] THEN 'slowing' WHEN slope < -0.1::DOUBLE * q[2] THEN 'accelerating' ELSE 'steady' END AS trend
 FROM (SELECT count(*) AS n, quantile_cont(g, [0.25, 0.5, 0.75]) AS q, regr_slope(g::DOUBLE, k::DOUBLE) AS slope FROM (SELECT g, row_number() OVER (ORDER BY date, tag) AS k FROM (
 SELECT tag, date, date_diff('day', lag(date) OVER (ORDER BY date, tag), date) AS g FROM tg) WHERE g IS NOT NULL))"""
    ),
    "kamei_features": with_facts(
        r"""SELECT o.rev, o.ns, o.nd, o.nf, o.entropy, o.la, o.ld, 0.0::DOUBLE AS lt, coalesce(regexp_matches(c.message, '(?i)\b(fix|bug|defect|patch|repair)\w*'), false) AS fix, coalesce(v.ndev, 0) AS ndev, coalesce(h.age, 0) AS age, coalesce(h.nuc, 0) AS nuc,
 coalesce(e.exp, 0) AS exp, round(coalesce(e.rexp, 0), 6) AS rexp, coalesce(x.sexp, 0) AS sexp FROM ow o JOIN c ON c.rev = o.rev LEFT JOIN hi h ON h.rev = o.rev LEFT JOIN dv v ON v.rev = o.rev LEFT JOIN ex e ON e.rev = o.rev LEFT JOIN sx x ON x.rev = o.rev""",
        {
            "ow": f"""SELECT rev, count(DISTINCT {_TOP}) AS ns, count(DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1)) AS nd, count(*) AS nf, round(coalesce(-sum(CASE WHEN p > 0 THEN p * log2(p) END), 0), 6) AS entropy,
 sum(loc_added)::BIGINT AS la, sum(loc_deleted)::BIGINT AS ld FROM (SELECT *, loc_added / nullif(sum(loc_added) OVER (PARTITION BY rev), 0)::DOUBLE AS p FROM ch) GROUP BY 1""",
            "hp": "SELECT a.rev, a.path, a.date, count(b.rev) AS prior, max(b.date) AS last_at FROM dc a LEFT JOIN dc b ON b.path = a.path AND b.date < a.date GROUP BY 1, 2, 3",
            "hi": "SELECT rev, sum(prior)::BIGINT AS nuc, round(coalesce(avg(date_diff('day', last_at, date)), 0), 6) AS age FROM hp GROUP BY 1",
            "me": "SELECT path, canonical_author, min(date) AS met_at FROM dc GROUP BY 1, 2",
            "dv": "SELECT a.rev, count(DISTINCT me.canonical_author) AS ndev FROM dc a JOIN me ON me.path = a.path AND me.met_at < a.date GROUP BY 1",
            "ex": "SELECT a.rev, count(b.rev) AS exp, sum(1.0::DOUBLE / (1 + year(a.date) - year(b.date))) AS rexp FROM c a JOIN c b ON a.canonical_author = b.canonical_author AND b.date < a.date GROUP BY 1",
            "tp": f"SELECT DISTINCT rev, canonical_author, date, {_TOP} AS top FROM dc",
            "sx": "SELECT rev, max(s) AS sexp FROM (SELECT a.rev, a.top, count(b.rev) AS s FROM tp a JOIN tp b ON a.canonical_author = b.canonical_author AND a.top = b.top AND b.date < a.date GROUP BY 1, 2) GROUP BY 1",
        },
    ),
    "monthly_trends": with_facts(
        """SELECT strftime(date, '%Y-%m') AS month, count(*) AS commits, count(DISTINCT canonical_author) AS authors, coalesce(sum(a), 0)::BIGINT AS added, coalesce(sum(d), 0)::BIGINT AS deleted
 FROM c LEFT JOIN (SELECT rev, sum(loc_added) AS a, sum(loc_deleted) AS d FROM ch GROUP BY 1) USING (rev) GROUP BY 1"""
    ),
    "control_charts": with_facts(
        """SELECT n, last, round(mean, 6) AS mean, round(mr, 6) AS moving_range, n >= 4 AND (abs(last - mean) > 2.66::DOUBLE * mr OR above = 8 OR below = 8) AS attention FROM (
 SELECT (SELECT count(*) FROM se) AS n, (SELECT arg_max(commits, month) FROM se) AS last, (SELECT avg(commits) FROM se) AS mean, (SELECT avg(abs(g)) FROM (SELECT commits - lag(commits) OVER (ORDER BY month) AS g FROM se)) AS mr,
 (SELECT count(*) FROM (SELECT * FROM se ORDER BY month DESC LIMIT 8) WHERE commits > (SELECT avg(commits) FROM se)) AS above, (SELECT count(*) FROM (SELECT * FROM se ORDER BY month DESC LIMIT 8) WHERE commits < (SELECT avg(commits) FROM se)) AS below)""",
        {"se": f"SELECT strftime(date, '%Y-%m') AS month, count(*) AS commits FROM c WHERE strftime(date, '%Y-%m') < strftime({AS_OF}, '%Y-%m') GROUP BY 1"},
    ),
    "evidence_commits": with_facts(
        """SELECT path, rev, pos, split_part(coalesce(message, ''), chr(10), 1) AS subject FROM (SELECT path, rev, row_number() OVER (PARTITION BY path ORDER BY date DESC, seq) AS pos FROM dc) JOIN c USING (rev) WHERE pos <= 3"""
    ),
    "new_code": with_facts(
        f"""SELECT path, CASE WHEN born >= {AS_OF} - INTERVAL 90 DAYS THEN 'born' ELSE 'touched' END AS scope, added FROM (SELECT path, min(date) AS born, max(date) AS last,
 sum(CASE WHEN date >= {AS_OF} - INTERVAL 90 DAYS THEN loc_added ELSE 0 END)::BIGINT AS added FROM dc WHERE date <= {AS_OF} GROUP BY 1) JOIN live USING (path) WHERE last >= {AS_OF} - INTERVAL 90 DAYS"""
    ),
    "delta_health": with_facts(
        """SELECT outcome, count(*) AS functions, sum(weight)::BIGINT AS weight FROM (SELECT CASE WHEN coalesce(b.r, 0) > coalesce(a.r, 0) THEN 'bad' WHEN coalesce(b.r, 0) < coalesce(a.r, 0) THEN 'good' WHEN a.l IS NULL THEN 'new' WHEN b.l IS NULL THEN 'removed' ELSE 'same' END AS outcome,
 greatest(coalesce(a.l, 0), coalesce(b.l, 0)) AS weight FROM fa a FULL JOIN fb b ON a.path = b.path AND a.base = b.base) GROUP BY 1""",
        {
            name: f"SELECT path, base, CASE WHEN max(loc) >= 71 OR max(cyclomatic) >= 11 THEN 2 WHEN max(loc) >= 31 OR max(cyclomatic) >= 6 THEN 1 ELSE 0 END AS r, max(loc) AS l FROM fn {where} GROUP BY 1, 2"
            for name, where in (("fa", "WHERE start_line <= 4"), ("fb", ""))
        },
    ),
    "ai_classes": with_facts(
        rf"""SELECT CASE WHEN {_BOT.format(x="lower(coalesce(author_name, ''))")} OR {_BOT.format(x="lower(coalesce(author_email, ''))")} THEN 'ai-authored'
 WHEN contains(lower(message), '(aider)') OR len(list_filter(list_filter(string_split(lower(message), chr(10)), lambda l: starts_with(trim(l), 'co-authored-by:')), lambda l: regexp_matches(l, '{_ASSISTANT}') OR {_BOT.format(x="l")})) > 0
 THEN 'ai-assisted' ELSE 'human' END AS kind, count(*) AS commits FROM c GROUP BY 1"""
    ),
    "scan_coverage": with_facts(
        "SELECT eligible, scored, eligible - scored AS lost, round(scored / eligible::DOUBLE, 6) AS share, scored / eligible::DOUBLE < 0.9 AS thin FROM (SELECT count(*) AS eligible, count(f.path) AS scored FROM live LEFT JOIN f ON f.path = live.path)"
    ),
    "szz_candidates": with_facts(
        r"""SELECT fix_rev, path, arg_max(rev, ROW(date, rev)) AS bug_rev FROM (SELECT f.rev AS fix_rev, f.path, h.rev, h.date FROM fx f JOIN hd_ h ON h.path = f.path AND h.date < f.date AND h.new_start < f.old_start + f.old_lines AND h.new_start + h.new_lines > f.old_start) GROUP BY 1, 2""",
        {
            "hd_": "SELECT hk.*, c.date FROM hk JOIN c USING (rev)",
            "fx": r"""SELECT * FROM hd_ WHERE old_lines > 0 AND rev IN (SELECT rev FROM c WHERE regexp_matches(message, '(?i)\b(fix|bug|defect)'))
 AND rev IN (SELECT rev FROM ch GROUP BY 1 HAVING count(*) <= 8 AND sum(loc_added + loc_deleted) <= 400)""",
        },
    ),
}
