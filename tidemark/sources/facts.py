"""The fact store: a version history as a set of lazily built DataFrames.

``commits``, ``changes`` and ``aliases`` come from tables of the same names. All other facts are read from a
given table where there is one, under the name of the fact or in the form of a scanner's table (``hunks``,
``commit_parents``, ``tags``, ``imports``, ``clones``, ``complexity_metrics`` with ``entities``). Only without one
they are derived: facts about the present state of the files (line counts, branch counts, functions,
dependencies, duplicated fragments) from the beginning of each file in ``blobs``, and hunks, parents and
tags from the history by fixed stand-in rules. Every derivation uses built-in expressions only.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import drop_staged, read_table, stage_table, staged_tables
from tidemark.sources.options import QueryOptions

BRANCH_WORDS = r"\b(if|for|while|case|match|catch|except|elif|switch)\b"
BOOL_WORDS = r"(&&|\|\||\?|=>)"
DEFINITION = r"^\s*(pub fn|func|def|export function|export const|public int|static int) [a-z]+_[a-z]+"
DEFINED_NAME = r"([a-z]+_[a-z]+)"
IMPORTED = r"""(?:use crate::|#include "|from '\./|from |package app\.|package )([a-z]+)"""
CLONE_LINES = 2


def repo_of(path: str | Column) -> Column:
    """The two top folders of a path."""
    return F.substring_index(path, "/", 2)


def folder_of(path: str | Column) -> Column:
    """The folder of a path, empty at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


class FactStore:
    """Facts of one data directory under one set of options; other sources can replace any table."""

    def __init__(self, spark: SparkSession, sf_dir: str, options: QueryOptions | None = None, **tables: DataFrame) -> None:
        self.spark, self.sf_dir, self.options = spark, sf_dir, options or QueryOptions()
        self._tables = tables
        self._memo: dict[object, DataFrame] = {}
        self._kept: list[DataFrame] = []

    def table(self, name: str) -> DataFrame:
        """A table given to the store, or else one of its directory."""
        return self._tables[name] if name in self._tables else read_table(self.spark, self.sf_dir, name)

    def given(self, name: str) -> DataFrame | None:
        """A table given to the store or present in its directory; nothing if there is none."""
        if name in self._tables:
            return self._tables[name]
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.sf_dir.rstrip('/')}/{name}.parquet")
        if path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return read_table(self.spark, self.sf_dir, name)
        return None

    def replacing(self, options: QueryOptions | None = None, **tables: DataFrame) -> FactStore:
        """This store with some tables replaced."""
        return FactStore(self.spark, self.sf_dir, options or self.options, **{**self._tables, **tables})

    def once(self, key: object, make: Callable[[], DataFrame]) -> DataFrame:
        """The same plan object for repeated use, so that Spark can reuse its exchanges; staged tables are kept."""
        if key not in self._memo:
            before = set(map(id, staged_tables()))
            self._memo[key] = make()
            for table in staged_tables():
                if id(table) not in before:
                    table.is_kept = True
                    self._kept.append(table)
        return self._memo[key]

    @property
    def keeps(self) -> bool:
        """Whether staged tables are kept for repeated use."""
        return bool(self._kept)

    def close(self) -> None:
        """Remove the staged tables that were kept for repeated use."""
        drop_staged(*self._kept)
        self._kept.clear()
        self._memo.clear()

    def with_options(self, **changes) -> FactStore:
        """The same tables under other options."""
        return FactStore(self.spark, self.sf_dir, self.options.but(**changes), **self._tables)

    @cached_property
    def moment(self) -> datetime:
        """The moment that analyses look back from: the option's, or the last commit's, but never later than now."""
        if self.options.as_of is not None:
            return datetime.fromisoformat(self.options.as_of)
        now = datetime.now(UTC).replace(tzinfo=None)
        last = self.commits.agg(F.date_format(F.max("date"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("t")).first()["t"]
        return min(now, datetime.fromisoformat(last)) if last else now

    @property
    def anchor(self) -> Column:
        """:attr:`moment` as a column."""
        return F.lit(self.moment.isoformat(sep=" ")).cast("timestamp")

    @cached_property
    def commits(self) -> DataFrame:
        """One row per revision; repeated rows are exact copies."""
        return self.table("commits").where("rev is not null").dropDuplicates(["rev"])

    @cached_property
    def changes(self) -> DataFrame:
        """One row per revision and path: as they were made, or with ``lineage`` under the name the file finally got."""
        if not self.options.lineage:
            return self.raw_changes
        from tidemark.operators.relations import lineage_changes

        final = self.once("lineage", lambda: lineage_changes(self.with_options(lineage=False)))
        return final.select("rev", "path", "change_type", F.lit(None).cast("string").alias("rename_from"), "loc_added", "loc_deleted")

    @cached_property
    def raw_changes(self) -> DataFrame:
        """One row per revision and path as recorded, with line counts that are neither null nor negative."""
        count = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)).cast("long").alias(c)
        return (
            self.table("changes")
            .where("rev is not null and path is not null")
            .repartition("rev")  # one exchange for this and for what is joined or summed by revision
            .dropDuplicates(["rev", "path"])
            .select("rev", "path", "change_type", "rename_from", count("loc_added"), count("loc_deleted"))
        )

    @cached_property
    def aliases(self) -> DataFrame:
        """Known raw identities, one row per name and address."""
        return self.table("author_aliases").groupBy("raw_name", "raw_email").agg(F.max("canonical").alias("canonical"), F.bool_or("is_bot").alias("is_bot"))

    @cached_property
    def human_commits(self) -> DataFrame:
        """Commits whose raw identity is a known human's."""
        humans = self.aliases.where("not is_bot").select(F.col("raw_name").alias("author_name"), F.col("raw_email").alias("author_email"))
        return self.commits.join(humans, ["author_name", "author_email"], "left_semi")

    @cached_property
    def dated_changes(self) -> DataFrame:
        """Changes with author, date and order of their commit."""
        c = self.commits.select("rev", "canonical_author", "author_email", "ai_attribution", "date", "committer_date", "is_merge", "seq")
        return self.changes.join(c, "rev")

    @cached_property
    def live_paths(self) -> DataFrame:
        """Paths whose latest change is no deletion."""
        return live_at(self.dated_changes, None)

    # what the files look like now ------------------------------------------------------------------

    @cached_property
    def blobs(self) -> DataFrame:
        """Readable files, one row per path."""
        return self.table("blobs").where("path is not null and content is not null").dropDuplicates(["path"]).select("path", "lang", "content")

    @cached_property
    def lines(self) -> DataFrame:
        """Lines of readable files with their number and the number of the function they are in."""
        exploded = self.blobs.select("path", "lang", F.posexplode(F.split("content", "\n")).alias("at", "line"))
        along = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        starts = F.col("line").rlike(DEFINITION).cast("int")
        return exploded.select("path", "lang", (F.col("at") + 1).alias("at"), "line").withColumn("fn", F.sum(starts).over(along))

    @cached_property
    def files(self) -> DataFrame:
        """Metrics of each readable file; of measured entities the greatest value, and the whole file's ``mi``."""
        if (known := self.given("files")) is not None:
            return known
        if (measured := self.given("complexity_metrics")) is not None:
            whole = self.table("entities").where("kind = 'unit'").select("path", "name").distinct().withColumn("unit", F.lit(True))
            most = [F.max(c).cast("long").alias(c) for c in ("loc", "sloc", "cognitive", "cyclomatic", "bool_ops", "max_nesting", "nargs")]
            ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
            per = measured.join(whole, ["path", "name"], "left").groupBy("path").agg(*most, F.max(F.when(F.col("unit"), F.col("mi"))).alias("mi"))
            return per.select("path", ending.alias("lang"), "loc", "sloc", "cognitive", "cyclomatic", "bool_ops", "max_nesting", "nargs", "mi")
        return self.once("files", lambda: stage_table(self._measured_blobs()))

    def _measured_blobs(self) -> DataFrame:
        """Metrics from the text of each readable file; reading all texts is dear, so :attr:`files` keeps the result."""
        branches = F.regexp_count("content", F.lit(BRANCH_WORDS)).cast("long")
        body = F.split("content", "\n")
        sloc = F.size(F.filter(body, lambda x: F.trim(x) != "")).cast("long")
        words = F.regexp_count("content", F.lit(r"[A-Za-z_]+")).cast("long")
        return self.blobs.select(
            "path",
            "lang",
            F.size(body).cast("long").alias("loc"),
            sloc.alias("sloc"),
            branches.alias("cognitive"),
            (branches + 1).alias("cyclomatic"),
            F.regexp_count("content", F.lit(BOOL_WORDS)).cast("long").alias("bool_ops"),
            F.regexp_count("content", F.lit(r"(?m)^ {4,}|^\t\t")).cast("long").alias("max_nesting"),
            F.regexp_count("content", F.lit(", ")).cast("long").alias("nargs"),
            (F.lit(171.0) - F.lit(5.2) * F.log((words + 1).cast("double")) - F.lit(0.23) * (branches + 1) - F.lit(16.2) * F.log((sloc + 1).cast("double"))).alias("mi"),
        )

    @cached_property
    def functions(self) -> DataFrame:
        """Functions of readable files: as measured, or lines from their definition to the next one."""
        if (known := self.given("functions")) is not None:
            return known
        if (measured := self.given("complexity_metrics")) is not None:
            spans = self.table("entities").where("kind = 'function'").groupBy("path", "name").agg(F.max("start_line").cast("long").alias("start_line"), F.max("end_line").cast("long").alias("end_line"))
            per = measured.groupBy("path", "name").agg(*[F.max(c).cast("long").alias(c) for c in ("loc", "cognitive", "cyclomatic")])
            base = F.regexp_replace("name", r"@[0-9]+-[0-9]+$", "").alias("base")
            return spans.join(per, ["path", "name"]).select("path", "name", base, "start_line", "end_line", "loc", "cognitive", "cyclomatic")
        return (
            self.lines.where("fn > 0")
            .groupBy("path", "fn")
            .agg(
                F.min("at").cast("long").alias("start_line"),
                F.max("at").cast("long").alias("end_line"),
                F.min_by(F.regexp_extract("line", DEFINED_NAME, 1), "at").alias("base"),
                F.sum(F.regexp_count("line", F.lit(BRANCH_WORDS))).cast("long").alias("cognitive"),
            )
            .select(
                "path",
                F.concat("base", F.lit("@"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string")).alias("name"),
                "base",
                "start_line",
                "end_line",
                (F.col("end_line") - F.col("start_line") + 1).alias("loc"),
                "cognitive",
                (F.col("cognitive") + 1).alias("cyclomatic"),
            )
        )

    @cached_property
    def hunks(self) -> DataFrame:
        """Changed regions; as a stand-in, one for every modification that adds lines."""
        if (known := self.given("hunks")) is not None:
            return known.select("rev", "path", *[F.col(c).cast("long").alias(c) for c in ("old_start", "old_lines", "new_start", "new_lines")]).dropDuplicates(["rev", "path", "old_start", "new_start"])
        return self.changes.where("change_type = 'modified' and loc_added > 0").select(
            "rev",
            "path",
            (F.col("loc_deleted") % 12 + 1).alias("old_start"),
            F.least("loc_deleted", F.lit(6)).alias("old_lines"),
            (F.col("loc_added") % 12 + 1).alias("new_start"),
            F.least("loc_added", F.lit(6)).alias("new_lines"),
        )

    @cached_property
    def imports(self) -> DataFrame:
        """Distinct dependencies of files: target, and the file it resolves to (as a stand-in, in the same repository)."""
        if (known := self.given("imports")) is not None:
            return known.groupBy("src_path", "target").agg(F.max("target_path").alias("target_path"), F.bool_or(F.coalesce("resolved", F.lit(False))).alias("resolved"))
        wanted = self.blobs.select("path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(IMPORTED), F.lit(1)))).alias("target"))
        word = F.regexp_extract("path", r"/([a-z]+)_[^/]*$", 1)
        targets = self.blobs.select(repo_of("path").alias("repo"), word.alias("target"), "path").where("target <> ''").groupBy("repo", "target").agg(F.min("path").alias("target_path"))
        return (
            wanted.withColumn("repo", repo_of("path"))
            .join(targets, ["repo", "target"], "left")
            .select(F.col("path").alias("src_path"), "target", "target_path", F.col("target_path").isNotNull().alias("resolved"))
        )

    @cached_property
    def import_edges(self) -> DataFrame:
        """Resolved dependencies without self-loops."""
        return self.imports.where("resolved and src_path <> target_path").select("src_path", "target_path").distinct()

    @cached_property
    def clones(self) -> DataFrame:
        """Members of duplicated fragments; as a stand-in, runs of lines that occur, numbers aside, in several places."""
        if (known := self.given("clones")) is not None:
            if "family_size" in known.columns:
                return known
            sizes = known.groupBy("clone_group_id").agg(F.count(F.lit(1)).alias("family_size"))
            return known.join(sizes, "clone_group_id").withColumns({c: F.col(c).cast("long") for c in ("start_line", "end_line", "node_count")})
        plain = self.lines.select("path", "at", F.regexp_replace("line", "[0-9]+", "#").alias("line"))
        ahead = Window.partitionBy("path").orderBy("at")
        fragment = F.concat_ws("\n", "line", *[F.lead("line", k).over(ahead) for k in range(1, CLONE_LINES)])
        framed = plain.select("path", "at", fragment.alias("text"), F.lead("line", CLONE_LINES - 1).over(ahead).alias("last")).where("last is not null")
        counted = framed.select("path", F.col("at").cast("long").alias("start_line"), F.sha2("text", 256).alias("fingerprint"), F.regexp_count("text", F.lit("[A-Za-z]+")).cast("long").alias("node_count"))
        members = counted.where("node_count >= 10")
        families = members.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("family_size")).where("family_size >= 2")
        return members.join(families, "fingerprint").withColumn("end_line", F.col("start_line") + CLONE_LINES - 1)

    @cached_property
    def parents(self) -> DataFrame:
        """Parents of commits as recorded; as a stand-in by ``seq``: the main line is every third commit and every merge.

        Main-line commits follow each other. Others follow the next older one of their kind, at most eight
        commits away, and every seventh starts from the main line. A merge's second parent is the next
        older commit off the main line. Neighbours are joined by their number, not by one global window.
        """
        for name in ("parents", "commit_parents"):
            if (known := self.given(name)) is not None:
                return known.where("rev is not null and parent_rev is not null").dropDuplicates(["rev", "position"]).select("rev", "position", "parent_rev")
        main = F.col("is_merge") | (F.col("seq") % 3 == 0)
        c = self.commits.select("rev", "seq", "is_merge", main.alias("main"))

        def next_older(kind: Column, reach: int, name: str) -> DataFrame:
            offsets = F.explode(F.sequence(F.lit(1), F.lit(reach)))
            return c.where(kind).select("rev", "seq", offsets.alias("k")).groupBy((F.col("seq") - F.col("k")).alias("seq")).agg(F.min_by("rev", "seq").alias(name))

        placed = c.join(next_older(F.col("main"), 3, "main_parent"), "seq", "left").join(next_older(~F.col("main"), 8, "side_parent"), "seq", "left")
        first = F.when(F.col("main") | (F.col("seq") % 7 == 0), F.col("main_parent")).otherwise(F.coalesce("side_parent", "main_parent"))
        second = placed.where("is_merge").select("rev", F.lit(1).alias("position"), F.col("side_parent").alias("parent_rev"))
        return placed.select("rev", F.lit(0).alias("position"), first.alias("parent_rev")).unionByName(second).where("parent_rev is not null")

    @cached_property
    def tags(self) -> DataFrame:
        """Tags as recorded; as a stand-in, a release tag on the first commit of every month."""
        if (known := self.given("tags")) is not None:
            return known.select(F.col("name" if "name" in known.columns else "tag").alias("tag"), "target_rev", "date")
        return (
            self.commits.groupBy(F.date_format("date", "yyyy.MM").alias("month"))
            .agg(F.min_by("rev", F.struct("date", -F.col("seq"))).alias("target_rev"), F.min("date").alias("date"))
            .select(F.concat(F.lit("v"), "month").alias("tag"), "target_rev", "date")
        )


def live_at(dated: DataFrame, moment: Column | None) -> DataFrame:
    """Paths whose latest change up to a moment is no deletion; of one second the newest commit counts."""
    seen = dated if moment is None else dated.where(F.col("date") <= moment)
    return seen.groupBy("path").agg(F.max_by("change_type", F.struct("date", -F.col("seq"))).alias("latest")).where("latest <> 'deleted'").select("path")
