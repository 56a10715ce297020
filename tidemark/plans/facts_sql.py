"""The facts of :mod:`tidemark.sources.facts` as SQL, for the counterpart of each query."""

from __future__ import annotations

import re

AS_OF = "TIMESTAMP '2026-05-01 00:00:00'"

FACTS = {
    "c": """SELECT DISTINCT rev, author_email, author_name, canonical_author, ai_attribution, (date AT TIME ZONE 'UTC') AS date,
 (committer_date AT TIME ZONE 'UTC') AS committer_date, committer_email, message, is_merge, parent_count, nf, fix, la, ld, seq FROM commits WHERE rev IS NOT NULL""",
    "ch": """SELECT DISTINCT rev, path, change_type, rename_from, greatest(coalesce(loc_added,0),0)::BIGINT AS loc_added,
 greatest(coalesce(loc_deleted,0),0)::BIGINT AS loc_deleted FROM changes WHERE rev IS NOT NULL AND path IS NOT NULL""",
    "al": "SELECT raw_name, raw_email, max(canonical) AS canonical, bool_or(is_bot) AS is_bot FROM author_aliases GROUP BY 1, 2",
    "hc": "SELECT * FROM c WHERE EXISTS (SELECT 1 FROM al WHERE NOT al.is_bot AND al.raw_name = c.author_name AND al.raw_email = c.author_email)",
    "dc": "SELECT ch.*, c.canonical_author, c.author_email, c.ai_attribution, c.date, c.committer_date, c.is_merge, c.seq FROM ch JOIN c USING (rev)",
    "live": "SELECT path FROM (SELECT path, arg_max(change_type, ROW(date, -seq)) AS latest FROM dc GROUP BY 1) WHERE latest <> 'deleted'",
    "b": "SELECT DISTINCT path, lang, content FROM blobs WHERE path IS NOT NULL AND content IS NOT NULL",
    "ln": r"""SELECT path, lang, lno, line, sum(CASE WHEN regexp_matches(line, '^\s*(pub fn|func|def|export function|export const|public int|static int) [a-z]+_[a-z]+') THEN 1 ELSE 0 END)
 OVER (PARTITION BY path ORDER BY lno)::BIGINT AS fn
 FROM (SELECT path, lang, generate_subscripts(parts, 1) AS lno, unnest(parts) AS line FROM (SELECT path, lang, string_split(content, chr(10)) AS parts FROM b))""",
    "f": r"""SELECT path, lang, len(string_split(content, chr(10)))::BIGINT AS loc,
 len(list_filter(string_split(content, chr(10)), lambda x: trim(x) <> ''))::BIGINT AS sloc,
 br AS cognitive, br + 1 AS cyclomatic,
 len(regexp_extract_all(content, '(&&|\|\||\?|=>)'))::BIGINT AS bool_ops,
 len(regexp_extract_all(content, '(?m)^ {4,}|^\t\t'))::BIGINT AS max_nesting,
 len(regexp_extract_all(content, ', '))::BIGINT AS nargs,
 171.0::DOUBLE - 5.2::DOUBLE * ln((len(regexp_extract_all(content, '[A-Za-z_]+')) + 1)::DOUBLE) - 0.23::DOUBLE * (br + 1)
 - 16.2::DOUBLE * ln((len(list_filter(string_split(content, chr(10)), lambda x: trim(x) <> '')) + 1)::DOUBLE) AS mi
 FROM (SELECT *, len(regexp_extract_all(content, '\b(if|for|while|case|match|catch|except|elif|switch)\b'))::BIGINT AS br FROM b)""",
    "fn": r"""SELECT path, base || '@' || start_line || '-' || end_line AS name, base, start_line, end_line, end_line - start_line + 1 AS loc, cognitive, cognitive + 1 AS cyclomatic FROM (
 SELECT path, fn, min(lno)::BIGINT AS start_line, max(lno)::BIGINT AS end_line, arg_min(regexp_extract(line, '([a-z]+_[a-z]+)', 1), lno) AS base,
 sum(len(regexp_extract_all(line, '\b(if|for|while|case|match|catch|except|elif|switch)\b')))::BIGINT AS cognitive FROM ln WHERE fn > 0 GROUP BY 1, 2)""",
    "hk": """SELECT rev, path, loc_deleted % 12 + 1 AS old_start, least(loc_deleted, 6) AS old_lines, loc_added % 12 + 1 AS new_start, least(loc_added, 6) AS new_lines
 FROM ch WHERE change_type = 'modified' AND loc_added > 0""",
    "im": r"""SELECT w.path AS src_path, w.target, t.target_path, t.target_path IS NOT NULL AS resolved FROM (
 SELECT DISTINCT path, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS repo,
 unnest(regexp_extract_all(content, '(?:use crate::|#include "|from ''\./|from |package app\.|package )([a-z]+)', 1)) AS target FROM b) w
 LEFT JOIN (SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS repo, regexp_extract(path, '/([a-z]+)_[^/]*$', 1) AS target, min(path) AS target_path
 FROM b WHERE regexp_extract(path, '/([a-z]+)_[^/]*$', 1) <> '' GROUP BY 1, 2) t USING (repo, target)""",
    "ie": "SELECT DISTINCT src_path, target_path FROM im WHERE resolved AND src_path <> target_path",
    "cl": r"""SELECT m.*, m.start_line + 1 AS end_line, g.family_size FROM (
 SELECT path, lno::BIGINT AS start_line, sha256(line || chr(10) || nxt) AS fingerprint, len(regexp_extract_all(line || chr(10) || nxt, '[A-Za-z]+'))::BIGINT AS node_count
 FROM (SELECT path, lno, regexp_replace(line, '[0-9]+', '#', 'g') AS line, lead(regexp_replace(line, '[0-9]+', '#', 'g')) OVER (PARTITION BY path ORDER BY lno) AS nxt FROM ln) WHERE nxt IS NOT NULL) m
 JOIN (SELECT fingerprint, count(*) AS family_size FROM (
 SELECT sha256(line || chr(10) || nxt) AS fingerprint, len(regexp_extract_all(line || chr(10) || nxt, '[A-Za-z]+')) AS nc
 FROM (SELECT path, lno, regexp_replace(line, '[0-9]+', '#', 'g') AS line, lead(regexp_replace(line, '[0-9]+', '#', 'g')) OVER (PARTITION BY path ORDER BY lno) AS nxt FROM ln) WHERE nxt IS NOT NULL)
 WHERE nc >= 10 GROUP BY 1 HAVING count(*) >= 2) g USING (fingerprint) WHERE m.node_count >= 10""",
    "mn": "SELECT rev, seq, is_merge, is_merge OR seq % 3 = 0 AS main FROM c",
    "pl": """SELECT mn.rev, mn.main, mn.is_merge, mn.seq,
 (SELECT min(o.seq) FROM mn o WHERE o.main AND o.seq BETWEEN mn.seq + 1 AND mn.seq + 3) AS mp,
 (SELECT min(o.seq) FROM mn o WHERE NOT o.main AND o.seq BETWEEN mn.seq + 1 AND mn.seq + 8) AS sp FROM mn""",
    "pa": """SELECT x.rev, x.position, mn.rev AS parent_rev FROM (
 SELECT rev, 0 AS position, CASE WHEN main OR seq % 7 = 0 THEN mp ELSE coalesce(sp, mp) END AS s FROM pl
 UNION ALL SELECT rev, 1, sp FROM pl WHERE is_merge) x JOIN mn ON mn.seq = x.s""",
    "tg": "SELECT 'v' || strftime(date, '%Y.%m') AS tag, arg_min(rev, ROW(date, -seq)) AS target_rev, min(date) AS date FROM c GROUP BY 1",
    "pr": "SELECT path, count(*) AS n_revs FROM ch GROUP BY 1",
}


def with_facts(body: str, own: dict[str, str] | None = None, recursive: bool = False) -> str:
    """``body`` with the facts and own relations it names, and theirs, in front."""
    known = {**FACTS, **(own or {})}
    order: list[str] = []

    def need(text: str, above: tuple[str, ...] = ()) -> None:
        for name in known:
            if name not in order and name not in above and re.search(rf"\b(?:FROM|JOIN|,)\s*{name}\b(?!\()", text):
                need(known[name], (*above, name))
                if name not in order:
                    order.append(name)

    need(body)
    parts = ",\n".join(f"{n} AS MATERIALIZED ({known[n]})" for n in order)
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts}\n{body}" if parts else body
