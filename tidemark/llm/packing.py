"""Texts packed into containers of fixed capacity, measured in tokens of a public tokenizer.

Method: bounded-space online packing. Each partition keeps a fixed number of open containers, places a
text into the one where it leaves the least room, and emits the fullest when none has room. What is still
open at the end of a partition is merged with the others' leftovers by the same rule, in rounds of bounded
size; only (container, used) pairs take part in that.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import settled, stage_table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_LEFTOVERS_PER_TASK = 200_000
_VOCABULARY_BYTES = 64 << 20
_ENCODERS: dict[str, object] = {}


class OpenContainers:
    """A fixed number of open containers with best-fit placing."""

    def __init__(self, capacity: int, windows: int) -> None:
        if capacity < 1 or windows < 1:
            raise ValueError("capacity and windows must be at least 1")
        self.capacity, self.windows = capacity, windows
        self._open: list[tuple[int, int]] = []  # (free, number), least room first
        self._next = 0

    def place(self, size: int) -> int:
        """The number of the container that takes an item of ``size`` (at most the capacity)."""
        if not 0 <= size <= self.capacity:
            raise ValueError(f"size {size} is not between 0 and {self.capacity}")
        k = bisect_left(self._open, (size, -1))
        if k < len(self._open):
            free, number = self._open.pop(k)
        else:
            if len(self._open) == self.windows:
                self._open.pop(0)  # the fullest is emitted
            free, number = self.capacity, self._next
            self._next += 1
        if free > size:
            insort(self._open, (free - size, number))
        return number

    def leftovers(self) -> list[tuple[int, int]]:
        """``(number, used)`` of the containers that are still open."""
        return [(number, self.capacity - free) for free, number in self._open]


def _encoder(ranks: bytes, key: str):
    if key not in _ENCODERS:
        import base64

        import public_tokenizers
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        _ENCODERS[key] = tiktoken.Encoding(key, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    return _ENCODERS[key]


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id`` and ``n_tokens`` of every document; whole texts are encoded.

    ``tokenizer`` names a rank file of at most 64 MB, which is read by the driver and broadcast. Null ids
    and texts give no rows; of a repeated id the longest text counts; an empty text has 0 tokens.
    """
    with open(tokenizer, "rb") as file:
        ranks = file.read(_VOCABULARY_BYTES + 1)
    if len(ranks) > _VOCABULARY_BYTES:
        raise ValueError("the tokenizer file is larger than 64 MB")
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, tokenizer)
        for batch in batches:
            sizes = [len(encoder.encode_ordinary(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens"])

    kept = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    return kept.mapInArrow(count, "doc_id long, n_tokens long").groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))


def _pack_partition(capacity: int, windows: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space = OpenContainers(capacity, windows)
        for batch in batches:
            numbers = [space.place(s) for s in batch["size"]]
            yield batch.assign(container=numbers, leftover=False, used=0)
        left = space.leftovers()
        yield pd.DataFrame({"doc_id": -1, "piece": -1, "size": 0, "container": [n for n, _ in left], "leftover": True, "used": [u for _, u in left]})

    return pack


def _merge_leftovers(capacity: int):
    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*batches, pd.DataFrame({"container": pd.Series(dtype="int64"), "used": pd.Series(dtype="int64")})])
        rows = rows.sort_values(["used", "container"], ascending=[False, True])
        space = OpenContainers(capacity, max(1, len(rows)))
        numbers = [space.place(int(u)) for u in rows["used"]]
        first: dict[int, int] = {}
        targets = [first.setdefault(n, c) for n, c in zip(numbers, rows["container"], strict=True)]
        yield pd.DataFrame({"container": rows["container"], "target": targets, "used": rows["used"]})

    return merge


@settled
def pack_items(sizes: DataFrame, capacity: int = 2048, windows: int = 64) -> DataFrame:
    """``doc_id``, ``piece``, ``n_tokens``, ``container`` for items of known size.

    ``sizes`` has ``doc_id`` (distinct) and ``n_tokens``. An item larger than the capacity, and no other, is
    split: its pieces 0, 1, ... fill containers of their own but for the last, which is packed like any item.
    An item of size 0 is one piece and goes into the fullest open container. Items with a null size get no
    row; an empty input gives none. Container numbers are unique, not dense.
    """
    full = F.floor(F.col("n_tokens") / capacity).cast("int")
    rest = (F.col("n_tokens") % capacity).cast("long")
    pieces = (
        sizes.where("n_tokens is not null")
        .withColumn("whole", F.when(F.col("n_tokens") > capacity, full).otherwise(0))
        .withColumn("last", F.when(F.col("n_tokens") > capacity, rest).otherwise(F.col("n_tokens")))
        .withColumn("pieces", F.col("whole") + F.when((F.col("whole") == 0) | (F.col("last") > 0), 1).otherwise(0))
        .select("doc_id", "whole", "last", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
        .select("doc_id", "piece", F.when(F.col("piece") < F.col("whole"), F.lit(capacity)).otherwise(F.col("last")).cast("long").alias("size"))
    )
    packed = (
        pieces.sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "piece")
        .mapInPandas(_pack_partition(capacity, windows), "doc_id long, piece int, size long, container long, leftover boolean, used long")
        .withColumn("container", F.spark_partition_id().cast("long") * (1 << 33) + F.col("container"))
    )
    packed = stage_table(packed)
    left = stage_table(packed.where("leftover").select("container", "used"))
    moves: DataFrame | None = None
    count = left.count()
    while count > 1:
        tasks = -(-count // _LEFTOVERS_PER_TASK)
        merged = stage_table(
            left.repartition(tasks, F.xxhash64("container"))
            .mapInPandas(_merge_leftovers(capacity), "container long, target long, used long")
        )
        step = merged.select("container", "target")
        if moves is None:
            moves = step
        else:
            onward = step.select(F.col("container").alias("target"), F.col("target").alias("onward"))
            moves = stage_table(moves.join(onward, "target").select("container", F.col("onward").alias("target")))
        left = stage_table(merged.groupBy(F.col("target").alias("container")).agg(F.sum("used").alias("used")))
        fewer = left.count()
        if tasks == 1 or fewer > 0.9 * count:
            break
        count = fewer
    rows = packed.where("not leftover")
    if moves is None:
        return rows.select("doc_id", "piece", F.col("size").alias("n_tokens"), "container")
    return rows.join(moves, "container", "left").select("doc_id", "piece", F.col("size").alias("n_tokens"), F.coalesce("target", "container").alias("container"))


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, windows: int = 64, tokenizer: str = TOKENIZER) -> DataFrame:
    """Documents packed by their tokens; see :func:`token_counts` and :func:`pack_items`."""
    return pack_items(token_counts(docs, doc_id, text, tokenizer), capacity, windows)
