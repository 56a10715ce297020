"""Readers of side files and of other engines' output."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SIDE_FILE_BYTES = 16 << 20

COMMIT_SCHEMA = (
    "rev string, author_email string, author_name string, committer_email string, canonical_author string, ai_attribution string, date timestamp, committer_date timestamp, "
    "message string, is_merge boolean, parent_count int, seq long, "
    "changes array<struct<path: string, change_type: string, rename_from: string, loc_added: int, loc_deleted: int, "
    "hunks: array<struct<old_start: int, old_lines: int, new_start: int, new_lines: int>>>>"
)
CHANGE_TYPES = ("added", "modified", "deleted", "renamed", "copied", "binary")


def _side_file(path: str) -> str:
    """The text of a small configuration file; larger files than 16 MB are refused."""
    if Path(path).stat().st_size > _SIDE_FILE_BYTES:
        raise ValueError(f"{path} is larger than a configuration file may be")
    return Path(path).read_text(encoding="utf-8")


def read_history(spark: SparkSession, path: str, include_merges: bool = True, after: str | None = None, before: str | None = None) -> dict[str, DataFrame]:
    """Commits, changes and hunks of a JSON-lines export, one commit a line.

    ``after`` and ``before`` bound the author's calendar day, both included. Merges carry no changes.
    """
    rows = spark.read.schema(COMMIT_SCHEMA).json(path)
    if not include_merges:
        rows = rows.where("not coalesce(is_merge, false)")
    if after:
        rows = rows.where(F.to_date("date") >= F.lit(after).cast("date"))
    if before:
        rows = rows.where(F.to_date("date") <= F.lit(before).cast("date"))
    each = rows.where("not coalesce(is_merge, false)").select("rev", F.explode("changes").alias("c"))
    changes = each.select("rev", "c.path", "c.change_type", "c.rename_from", F.coalesce("c.loc_added", F.lit(0)).alias("loc_added"), F.coalesce("c.loc_deleted", F.lit(0)).alias("loc_deleted"))
    hunks = each.where("c.change_type = 'modified'").select("rev", "c.path", F.explode("c.hunks").alias("h")).select("rev", "path", "h.*")
    return {"commits": rows.drop("changes"), "changes": checked_changes(changes), "hunks": hunks}


def checked_changes(changes: DataFrame) -> DataFrame:
    """Changes whose type is known; an unknown type fails the query."""
    known = F.col("change_type").isin(*CHANGE_TYPES)
    message = F.concat(F.lit("unknown change type "), F.coalesce("change_type", F.lit("null")))
    return changes.withColumn("change_type", F.when(known, F.col("change_type")).otherwise(F.raise_error(message).cast("string")))


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression: ``**`` spans folders, ``*`` and ``?`` do not.

    A glob without a slash matches at any depth; a trailing slash means everything below the folder.
    """
    body = glob.strip("/") if "/" in glob.strip("/") else "**/" + glob.strip("/")
    out, k = "", 0
    while k < len(body):
        if body.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif body.startswith("**", k):
            out, k = out + ".*", k + 2
        else:
            ch = body[k]
            out += "[^/]*" if ch == "*" else "[^/]" if ch == "?" else ch if ch.isalnum() or ch in "/_" else "\\" + ch
            k += 1
    return f"^{out}(?:/.*)?$"


def exclude_paths(changes: DataFrame, globs: Iterable[str]) -> DataFrame:
    """Changes outside the version store's own folder and the given globs; null paths stay."""
    patterns = [r"^(?:.*/)?\.git(?:/.*)?$", *[glob_pattern(g.strip()) for g in globs if g.strip() and not g.strip().startswith("#")]]
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.coalesce(F.col("path").rlike(p), F.lit(False))
    return changes.where(~hit)


def read_team_map(spark: SparkSession, path: str) -> DataFrame:
    """``author``, ``team`` from a CSV with that header; blank or repeated authors are errors."""
    lines = [line for line in _side_file(path).splitlines() if line.strip()]
    if not lines or lines[0].replace(" ", "").lower() != "author,team":
        raise ValueError("the team map must start with the header author,team")
    teams: dict[str, str] = {}
    for number, line in enumerate(lines[1:], 2):
        author, comma, team = line.rpartition(",")
        if not comma or not author.strip() or not team.strip():
            raise ValueError(f"line {number} of the team map is not author,team")
        if author.strip() in teams:
            raise ValueError(f"line {number} of the team map repeats {author.strip()}")
        teams[author.strip()] = team.strip()
    return spark.createDataFrame(sorted(teams.items()), "author string, team string")


def fold_teams(commits: DataFrame, teams: DataFrame) -> DataFrame:
    """Commits under their author's team where the map names one."""
    small = teams.select(F.col("author").alias("canonical_author"), "team")
    return commits.join(small, "canonical_author", "left").withColumn("canonical_author", F.coalesce("team", "canonical_author")).drop("team")


def read_groups(path: str) -> list[tuple[str, str]]:
    """Ordered ``(pattern, name)`` rules of a group file: ``pattern => name``, ``#`` starts a comment."""
    rules = []
    for number, line in enumerate(_side_file(path).splitlines(), 1):
        text = line.strip()
        if not text or text.startswith("#"):
            continue
        pattern, arrow, name = text.partition("=>")
        if not arrow or not pattern.strip() or not name.strip():
            raise ValueError(f"line {number} of the group file is not pattern => name")
        rules.append((pattern.strip(), name.strip()))
    return rules


def read_layers(path: str) -> dict[str, tuple[list[str], list[str]]]:
    """Layers of a TOML file: name to path prefixes and layers it may depend on, all of them declared."""
    layers = {name: (list(v["paths"]), list(v.get("may_depend_on", []))) for name, v in tomllib.loads(_side_file(path)).get("layer", {}).items()}
    for name, (_, may) in layers.items():
        if missing := set(may) - set(layers):
            raise ValueError(f"layer {name} depends on undeclared {sorted(missing)}")
    return layers


def read_thresholds(path: str) -> dict[str, float]:
    """The numeric gates of a TOML file."""
    return {k: float(v) for k, v in tomllib.loads(_side_file(path)).get("gates", {}).items() if isinstance(v, (int, float)) and not isinstance(v, bool)}


# Account names of machines, and the names assistants sign with (alone, or followed by a word of the second list).
DEFAULT_BOTS = ("dependabot[bot]", "github-actions[bot]", "claude-code[bot]", "copilot[bot]", "renovate[bot]", "pre-commit-ci[bot]", "devin-ai-integration[bot]")
ASSISTANTS = ("claude", "copilot", "github copilot", "cursor", "sourcegraph cody", "cody", "continue", "codeium", "windsurf", "devin", "tabnine", "amazon q")
ASSISTANT_WORDS = ("agent", "ai", "assistant", "bot", "code")


def read_bots(path: str) -> list[str]:
    """The default patterns and those of a file, one a line; ``#`` starts a comment."""
    return [*DEFAULT_BOTS, *(line.strip().lower() for line in _side_file(path).splitlines() if line.strip() and not line.strip().startswith("#"))]


def bot_condition(name: str | Column, email: str | Column, patterns: Iterable[str] = DEFAULT_BOTS) -> Column:
    """True where a name or address contains one of the patterns, whatever the case."""
    hit = F.lit(False)
    for p in patterns:
        for text in (name, email):
            hit = hit | F.coalesce(F.lower(text).contains(p.strip().lower()), F.lit(False))
    return hit


def attribution(name: Column, email: Column, message: Column, patterns: Iterable[str] = DEFAULT_BOTS) -> Column:
    """``ai-authored`` for a bot's commit; ``ai-assisted`` where the message is signed by one or by an assistant; else ``human``.

    A co-author counts as an assistant only if the whole name is one, so that people who share a given name
    with a product stay people.
    """
    alone = "|".join(ASSISTANTS)
    signed = F.filter(F.split(F.lower(message), "\n"), lambda x: F.trim(x).startswith("co-authored-by:"))
    assistant = F.exists(signed, lambda x: x.rlike(rf"^\s*co-authored-by:\s*(?:{alone})(?: +(?:{'|'.join(ASSISTANT_WORDS)}))*\s*(?:<|$)"))
    wanted = [p.strip().lower() for p in patterns if p.strip()]
    machine = F.exists(signed, lambda x: F.exists(F.array(*map(F.lit, wanted)), lambda p: x.contains(p))) if wanted else F.lit(False)
    marked = F.coalesce(F.lower(message).contains("(aider)") | assistant | machine, F.lit(False))
    return F.when(bot_condition(name, email, patterns), "ai-authored").when(marked, "ai-assisted").otherwise("human")


def read_mailmap(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a mail map: ``new_name``, ``new_email``, ``old_name``, ``old_email``; absent parts are null.

    Lines are ``New <new>``, ``<new> <old>``, ``New <new> <old>`` or ``New <new> Old <old>``; ``#`` starts a comment.
    """
    rows = []
    for number, line in enumerate(_side_file(path).splitlines(), 1):
        text = line.split("#", 1)[0].strip()
        if not text:
            continue
        parts = re.fullmatch(r"([^<>]*)<([^<>]*)>(?:([^<>]*)<([^<>]*)>)?", text)
        if not parts:
            raise ValueError(f"line {number} of the mail map is not understood")
        a, b, c, d = (p.strip() if p else None for p in parts.groups())
        rows.append((a or None, b if d is not None else None, c or None, (d if d is not None else b).lower()))
    return spark.createDataFrame(rows, "new_name string, new_email string, old_name string, old_email string")


def apply_mailmap(commits: DataFrame, mailmap: DataFrame) -> DataFrame:
    """Commits with ``canonical_author`` made from name and address after the map; entries with a name go first."""
    named = mailmap.where("old_name is not null").select(F.lower("old_name").alias("_name"), F.col("old_email").alias("_mail"), F.col("new_name").alias("_n1"), F.col("new_email").alias("_e1")).dropDuplicates(["_name", "_mail"])
    plain = mailmap.where("old_name is null").select(F.col("old_email").alias("_mail"), F.col("new_name").alias("_n2"), F.col("new_email").alias("_e2")).dropDuplicates(["_mail"])
    keyed = commits.withColumn("_name", F.lower("author_name")).withColumn("_mail", F.lower("author_email"))
    joined = keyed.join(named, ["_name", "_mail"], "left").join(plain, "_mail", "left")
    exact = F.col("_n1").isNotNull() | F.col("_e1").isNotNull()
    name = F.when(exact, F.coalesce("_n1", "author_name")).otherwise(F.coalesce("_n2", "author_name"))
    email = F.when(exact, F.coalesce("_e1", "author_email")).otherwise(F.coalesce("_e2", "author_email"))
    return joined.withColumn("canonical_author", F.concat(F.coalesce(name, F.lit("")), F.lit(" <"), F.coalesce(email, F.lit("")), F.lit(">"))).drop("_name", "_mail", "_n1", "_e1", "_n2", "_e2")


def read_ignore(path: str) -> list[str]:
    """The globs of an ignore file; ``#`` starts a comment, negated lines are refused."""
    lines = [line.strip() for line in _side_file(path).splitlines()]
    globs = [line for line in lines if line and not line.startswith("#")]
    if negated := [g for g in globs if g.startswith("!")]:
        raise ValueError(f"negated globs are not supported: {negated}")
    return globs


def read_sarif(spark: SparkSession, path: str) -> DataFrame:
    """Findings of SARIF 2.1.0 files: engine, version, rule, path, lines, level, fingerprint, message.

    A missing level is a warning; a result without a location has a null path; without a fingerprint, the
    digest of engine, rule, path, line and message stands for it.
    """
    region = "struct<startLine: int, endLine: int>"
    location = f"struct<physicalLocation: struct<artifactLocation: struct<uri: string>, region: {region}>>"
    result = f"struct<ruleId: string, level: string, message: struct<text: string>, locations: array<{location}>, partialFingerprints: map<string, string>>"
    schema = f"runs array<struct<tool: struct<driver: struct<name: string, version: string, semanticVersion: string>>, results: array<{result}>>>"
    runs = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("runs").alias("run"))
    r = runs.select(F.col("run.tool.driver.name").alias("engine"), F.coalesce("run.tool.driver.semanticVersion", "run.tool.driver.version").alias("engine_version"), F.explode("run.results").alias("r"))
    place = F.get("r.locations", F.lit(0)).getField("physicalLocation")
    flat = r.select(
        "engine",
        "engine_version",
        F.col("r.ruleId").alias("rule_id"),
        place.getField("artifactLocation").getField("uri").alias("path"),
        place.getField("region").getField("startLine").alias("start_line"),
        F.coalesce(place.getField("region").getField("endLine"), place.getField("region").getField("startLine")).alias("end_line"),
        F.coalesce("r.level", F.lit("warning")).alias("level"),
        F.get(F.map_values("r.partialFingerprints"), F.lit(0)).alias("given"),
        F.col("r.message.text").alias("message"),
    )
    made = F.sha2(F.concat_ws("\u0001", "engine", "rule_id", "path", F.col("start_line").cast("string"), "message"), 256)
    return flat.select("engine", "engine_version", "rule_id", "path", "start_line", "end_line", "level", F.coalesce("given", made).alias("fingerprint"), "message")


def replace_engine(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Findings after a new scan: those of the scanned engines are replaced, others stay."""
    return existing.join(incoming.select("engine").distinct(), "engine", "left_anti").unionByName(incoming)


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """The strata of a calibration artifact, in the form of the ``strata`` table."""
    metric = "struct<metric: string, quantiles: array<double>>"
    stratum = f"struct<sloc_min: long, sloc_max: long, metrics: array<{metric}>>"
    schema = f"format_version int, corpus_vintage string, languages array<struct<language: string, sample_functions: long, strata: array<{stratum}>>>"
    a = spark.read.schema(schema).option("multiLine", True).json(path)
    lang = a.select(F.input_file_name().alias("artifact_id"), "corpus_vintage", F.explode("languages").alias("l"))
    return lang.select("artifact_id", "corpus_vintage", F.col("l.language").alias("lang"), F.col("l.sample_functions").alias("sample_functions"), F.explode("l.strata").alias("s")).select(
        "artifact_id", "corpus_vintage", "lang", "sample_functions", "s.sloc_min", "s.sloc_max", "s.metrics"
    )
