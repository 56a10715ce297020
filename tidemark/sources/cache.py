"""Facts kept in Parquet under a key of what they were made from."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.facts import FactStore

SCHEMA_VERSION = "1"
KEPT = ("files", "functions", "imports", "clones", "hunks", "parents")


def store_key(repository: str, head: str, **made_from: str) -> str:
    """The key of a store: repository, newest revision, what its making depends on, and the schema's version."""
    text = json.dumps([SCHEMA_VERSION, repository, head, sorted(made_from.items())])
    return hashlib.sha256(text.encode()).hexdigest()[:32]


def _complete(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def cached_facts(fs: FactStore, root: str, key: str, names: tuple[str, ...] = KEPT) -> dict[str, DataFrame]:
    """Derived facts by name, read from the cache where a complete copy is there, else written first.

    A copy is complete once Spark's commit left its mark; a broken writing is overwritten.
    """
    out = {}
    for name in names:
        folder = f"{root.rstrip('/')}/{key}/{name}.parquet"
        if not _complete(fs.spark, folder):
            getattr(fs, name).write.mode("overwrite").parquet(folder)
        out[name] = fs.spark.read.parquet(folder)
    return out
