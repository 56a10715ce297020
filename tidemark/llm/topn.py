"""The N best items of every group, by a loser-tree merge of sorted runs.

Every partition of the deduplicated rows is one run, ordered by bucket, group and score and read with a
seek to the next group after N rows, as a run's later rows of a group cannot be among the group's first N.
Runs are stored in the shared folder cut by bucket: one row holds the stretch of a run that falls into a
bucket (or a part of it of bounded length), still in order. Each bucket then merges its stretches with a
loser tree, which again seeks to the next group after N outputs; no row is sorted twice. A group with
millions of items is spread over all runs and reaches its bucket with at most N rows of each run.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import is_number, settled, stage_table

_END = (1,)


class LoserTree:
    """A tournament over the heads of sorted runs: ``winner`` is the run with the least head."""

    def __init__(self, heads: list[tuple]) -> None:
        self.heads = heads
        size = len(heads)
        self._losers = [-1] * max(size, 1)
        self.winner = -1
        for leaf in range(size):
            self._enter(leaf, building=True)

    def _enter(self, run: int, building: bool = False) -> None:
        heads, losers = self.heads, self._losers
        node = (run + len(heads)) >> 1
        while node > 0:
            other = losers[node]
            if other < 0 and building:
                losers[node] = run
                return
            if heads[other] < heads[run]:
                losers[node], run = run, other
            node >>= 1
        self.winner = run

    def replace(self, head: tuple) -> None:
        """Give the winning run a new head and play its path again."""
        run = self.winner
        self.heads[run] = head
        self._enter(run)


class _Run:
    """Rows of one run in order, with a cursor."""

    __slots__ = ("at", "groups", "items", "scores")

    def __init__(self, groups: list, items: list, scores: list) -> None:
        self.groups, self.items, self.scores, self.at = groups, items, scores, 0

    def head(self) -> tuple:
        k = self.at
        return (0, self.groups[k], -self.scores[k], self.items[k]) if k < len(self.groups) else _END

    def seek_past(self, group: str) -> None:
        self.at = bisect_right(self.groups, group, lo=self.at)


def merge_runs(runs: Iterable[tuple[list, list, list]], n: int) -> Iterator[tuple[str, str, float, int]]:
    """``(group, item, score, position)`` of the first ``n`` of every group over all runs."""
    cursors = [_Run(*r) for r in runs]
    if not cursors:
        return
    tree = LoserTree([c.head() for c in cursors])
    group, position = None, 0
    while True:
        head = tree.heads[tree.winner]
        if head is _END:
            return
        run = cursors[tree.winner]
        if position == 0 or head[1] != group:
            group, position = head[1], 0
        if position < n:
            position += 1
            yield group, head[3], -head[2], position
            run.at += 1
        else:
            run.seek_past(group)
        tree.replace(run.head())


_STRETCH = pa.schema([("bucket", pa.int32()), ("run", pa.int32()), ("part", pa.int32()), ("g", pa.list_(pa.string())), ("i", pa.list_(pa.string())), ("s", pa.list_(pa.float64()))])
_STRETCH_ROWS = 50_000


def _cut_runs(n: int):
    """Rows in the order of bucket, group, score and item to stretches that keep the first ``n`` of each group."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        run = TaskContext.get().partitionId()
        last, taken, part = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column("g").dictionary_encode()
            index = codes.indices.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate(([True], index[1:] != index[:-1])))
            place = np.arange(len(index)) - np.repeat(starts, np.diff(np.append(starts, len(index))))
            first = codes.dictionary[int(index[0])].as_py()
            head = int(starts[1]) if len(starts) > 1 else len(index)
            if first == last:
                place[:head] += taken
            last = codes.dictionary[int(index[-1])].as_py()
            taken = int(place[-1]) + 1
            kept = batch.filter(pa.array(place < n))
            if not kept.num_rows:
                continue
            bucket = kept.column("bucket").to_numpy()
            edges = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
            cuts = [(a + k, min(a + k + _STRETCH_ROWS, b)) for a, b in zip(edges, edges[1:], strict=False) for k in range(0, b - a, _STRETCH_ROWS)]
            offsets = pa.array([a for a, _ in cuts] + [len(bucket)], pa.int32())
            columns = [
                pa.array([int(bucket[a]) for a, _ in cuts], pa.int32()),
                pa.array([run] * len(cuts), pa.int32()),
                pa.array(range(part, part + len(cuts)), pa.int32()),
                *(pa.ListArray.from_arrays(offsets, kept.column(c)) for c in ("g", "i", "s")),
            ]
            part += len(cuts)
            yield pa.RecordBatch.from_arrays(columns, schema=_STRETCH)

    return cut


def _merge_buckets(n: int, schema: pa.Schema):
    """Stretches in the order of bucket, run and part to the first ``n`` of every group."""

    def rows_of(held: list[tuple[int, list, list, list]]) -> Iterator[tuple]:
        runs: dict[int, tuple[list, list, list]] = {}
        for run, *columns in held:
            mine = runs.setdefault(run, ([], [], []))
            for own, more in zip(mine, columns, strict=True):
                own.extend(more)
        return merge_runs(runs.values(), n)

    def batches_of(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        while out := [row for _, row in zip(range(20_000), rows, strict=False)]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for bucket, run, *columns in zip(*(batch.column(c).to_pylist() for c in ("bucket", "run", "g", "i", "s")), strict=True):
                if bucket != at:
                    yield from batches_of(rows_of(held))
                    at, held = bucket, []
                held.append((run, *columns))
        yield from batches_of(rows_of(held))

    return merge


@settled
def top_n_per_group(df: DataFrame, group: str, item: str, score: str, n: int = 3, bucket_rows: int = 400_000) -> DataFrame:
    """The ``n`` items of every group with the greatest score; equal scores go by item ascending.

    Result: ``group``, ``item``, ``score``, ``pos`` (1 to n). Groups with fewer items give fewer rows.

    Defined cases: rows with a null group or item, or a null or NaN score, do not count; an item counts
    once per group with its greatest score; strings order by UTF-8 bytes; empty strings are values like
    others; an empty input gives no rows. Other columns are ignored, whatever their names.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    best = (
        df.select(F.col(group).cast("string").alias("g"), F.col(item).cast("string").alias("i"), F.col(score).cast("double").alias("s"))
        .where(F.col("g").isNotNull() & F.col("i").isNotNull() & is_number(F.col("s")))
        .groupBy("g", "i")
        .agg(F.max("s").alias("s"))
    )
    spark = df.sparkSession
    # a bucket is what one task merges in memory
    found = df.agg(F.count(group).alias("n")).first()["n"]
    buckets = max(1, -(-found // bucket_rows), spark.sparkContext.defaultParallelism)
    runs = stage_table(
        best.select(F.pmod(F.xxhash64("g"), F.lit(buckets)).cast("int").alias("bucket"), "g", "i", "s")
        .sortWithinPartitions("bucket", "g", F.desc("s"), "i")
        .mapInArrow(_cut_runs(n), "bucket int, run int, part int, g array<string>, i array<string>, s array<double>")
    )
    # stretches are few: ordering them by number moves no item out of its place
    bucketed = runs.repartition(buckets, "bucket").sortWithinPartitions("bucket", "run", "part").drop("part")
    schema = pa.schema([("group", pa.string()), ("item", pa.string()), ("score", pa.float64()), ("pos", pa.int64())])
    return bucketed.mapInArrow(_merge_buckets(n, schema), "group string, item string, score double, pos long")
