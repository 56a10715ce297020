"""Writers of results.

Results of any size go to CSV, JSON, NDJSON and Parquet through Spark's own writers and commit protocol.
Markdown, SARIF and annotations are reports that people read: they take at most ``limit`` rows, the worst
first, and say so when there were more.
"""

from __future__ import annotations

import hashlib
import html
import json
from collections.abc import Iterable
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

REPORT_ROWS = 5_000


def guarded(df: DataFrame) -> DataFrame:
    """Text that a spreadsheet would take for a formula gets a leading apostrophe."""
    return df.select(*[F.when(F.col(f"`{c}`").rlike(r"^[=+\-@\t]"), F.concat(F.lit("'"), F.col(f"`{c}`"))).otherwise(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, quoted by RFC 4180, formulas guarded."""
    guarded(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_ndjson(df: DataFrame, path: str) -> None:
    """One JSON object a line; null columns are left out."""
    df.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def write_parquet(df: DataFrame, path: str, by: Iterable[str] = ()) -> None:
    """Parquet, on request in one folder per value of ``by``."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_store(tables: dict[str, DataFrame], path: str) -> None:
    """All tables of a store, one Parquet folder each."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")


def write_findings(findings: DataFrame, path: str) -> None:
    """Findings in one folder per engine; a new scan of an engine replaces only its folder."""
    findings.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("engine").parquet(path)


def to_json_array(df: DataFrame, limit: int = REPORT_ROWS) -> str:
    """A JSON array of all rows; null columns are left out. More than ``limit`` rows are an error: they belong in NDJSON."""
    rows = df.limit(limit + 1).toJSON().collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows; write_ndjson takes any number")
    return "[" + ",".join(rows) + "]"


def to_markdown(df: DataFrame, limit: int = REPORT_ROWS) -> str:
    """A table for people: at most ``limit`` rows, and a note if there were more."""
    rows = df.limit(limit + 1).collect()
    text = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(text(v) for v in r) + " |" for r in rows[:limit]]
    if len(rows) > limit:
        lines.append(f"\nThe first {limit} rows are shown.")
    return "\n".join(lines) + "\n"


def severity(health: float) -> float:
    """Severity of a file by its health: a quarter of what is missing, 0.1 at least."""
    return max((100.0 - health) / 4.0, 0.1)


def level_of(value: float, lowest: str = "note") -> str:
    """error from 7, warning from 4, else the lowest level."""
    return "error" if value >= 7.0 else "warning" if value >= 4.0 else lowest


def to_sarif(df: DataFrame, rule: str, health: str = "cognitive_health", message: str = "changes often and is complex", limit: int = REPORT_ROWS) -> str:
    """A SARIF 2.1.0 report of files by health, worst first; fingerprints depend on rule and path only."""
    rows = df.orderBy(F.asc(health), "path").limit(limit + 1).select("path", health).collect()
    results = [
        {
            "ruleId": rule,
            "level": level_of(severity(r[health])),
            "message": {"text": f"{r['path']} {message}"},
            "locations": [{"physicalLocation": {"artifactLocation": {"uri": r["path"]}}}],
            "partialFingerprints": {"primary": hashlib.sha256(f"{rule}\x00{r['path']}".encode()).hexdigest()},
            "properties": {"severity": severity(r[health])},
        }
        for r in rows[:limit]
    ]
    run: dict[str, object] = {"tool": {"driver": {"name": "tidemark", "rules": [{"id": rule}]}}, "results": results}
    if len(rows) > limit:
        run["invocations"] = [{"executionSuccessful": True, "toolExecutionNotifications": [{"level": "warning", "message": {"text": f"Only the first {limit} results are listed."}}]}]
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [run]}, indent=1)


def to_annotations(df: DataFrame, title: str, health: str = "cognitive_health", limit: int = 50) -> list[str]:
    """Workflow commands of a build service, worst file first, escaped."""

    def escaped(text: str, inside: bool = False) -> str:
        text = text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
        return text.replace(":", "%3A").replace(",", "%2C") if inside else text

    rows = df.orderBy(F.asc(health), "path").limit(limit + 1).select("path", health).collect()
    out = [f"::{level_of(severity(r[health]), 'notice')} file={escaped(r['path'], True)},title={escaped(title, True)}::{escaped(f'health {r[health]:.1f}')}" for r in rows[:limit]]
    return [*out, f"::notice title={escaped(title, True)}::Only the first {limit} files are annotated"] if len(rows) > limit else out


def to_step_summary(title: str, sections: dict[str, DataFrame], limit: int = 20) -> str:
    """A build step's summary: a heading and one short table per section, with a note where rows were left out."""
    return "\n".join([f"## {title}", *[f"\n### {name}\n\n{to_markdown(df, limit)}" for name, df in sections.items()]])


def to_html(df: DataFrame, title: str, limit: int = REPORT_ROWS) -> str:
    """A page with one table of at most ``limit`` rows, and a note if there were more."""
    rows = df.limit(limit + 1).collect()
    cell = lambda tag, v: f"<{tag}>{html.escape('' if v is None else str(v))}</{tag}>"
    table = "".join(f"<tr>{''.join(cell('td', v) for v in r)}</tr>" for r in rows[:limit])
    note = f"<p>The first {limit} rows are shown.</p>" if len(rows) > limit else ""
    head = "".join(cell("th", c) for c in df.columns)
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><table><tr>{head}</tr>{table}</table>{note}</body></html>"


def write_dashboard(datasets: dict[str, DataFrame], path: str) -> None:
    """The datasets of a dashboard, one folder of JSON lines each, and an index of their names and columns."""
    for name, df in datasets.items():
        write_ndjson(df, f"{path}/{name}")
    spark = next(iter(datasets.values())).sparkSession
    spark.createDataFrame([(n, d.columns) for n, d in datasets.items()], "name string, columns array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/index")


def ledger_history(spark: SparkSession, path: str) -> DataFrame:
    """Verdicts of a ledger in time, each with the one before it of the same gate: ``gate``, ``at``, ``head``, ``verdict``, ``before``."""
    along = Window.partitionBy("gate").orderBy("at")
    return spark.read.json(path).select("gate", "at", "head", "verdict", "violations", F.lag("verdict").over(along).alias("before"))


def write_provenance(path: str, options: object, **pins: str) -> None:
    """A JSON file beside a result: its options, pins and time."""
    record = {"options": dict(vars(options)), "pins": pins, "written_at": datetime.now(UTC).isoformat()}
    temporary = Path(f"{path}.part")
    temporary.write_text(json.dumps(record, indent=1, default=str), encoding="utf-8")
    temporary.replace(path)


def append_ledger(verdicts: DataFrame, path: str, head: str, at: str) -> None:
    """Gate verdicts appended to the ledger's folder."""
    verdicts.withColumn("head", F.lit(head)).withColumn("at", F.lit(at)).write.mode("append").json(path)
