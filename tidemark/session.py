"""Session helpers: reading tables, and cutting lineage through shared storage.

Intermediate results that a driver loop needs go to the folder the cluster names in
``spark.checkpoint.dir``. They are ordinary Parquet files there, so a lost executor costs only the tasks
it was running. Nothing here uses machine-local temporary folders on a cluster; only a ``local`` master
without the setting (tests) gets a folder of its own.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Sequence
from functools import wraps
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_FALLBACK: dict[str, str] = {}
#: Folders of staged tables that exist, in the order they were made.
_STAGED: dict[str, DataFrame] = {}
Made = TypeVar("Made", bound=Callable[..., DataFrame])


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, read from the session."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _LOCAL_FALLBACK:
        folder = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _LOCAL_FALLBACK[key] = f"file://{folder}"
        spark.sparkContext.setCheckpointDir(_LOCAL_FALLBACK[key])
    return _LOCAL_FALLBACK[key]


def stage_table(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and return a reader of what was written.

    The result has no lineage: later stages, retries included, read the same rows in the same files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-tables/{uuid.uuid4().hex}"
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.staged_path = path
    _STAGED[path] = staged
    return staged


def drop_staged(*tables: DataFrame) -> None:
    """Remove the files of tables made by :func:`stage_table` that nothing reads any more; once is enough."""
    for df in tables:
        if _STAGED.pop(df.staged_path, None) is None:
            continue
        spark = df.sparkSession
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def staged_tables() -> list[DataFrame]:
    """The staged tables that exist."""
    return list(_STAGED.values())


def settled(operator: Made) -> Made:
    """An operator that leaves one staged table, its result, in place of those it made on its way.

    Tables that the operator got, or that a fact store keeps for repeated use, stay. An operator that
    staged nothing returns its plan as it is. Not for use from several threads at once.
    """

    @wraps(operator)
    def run(*args, **kwargs) -> DataFrame:
        before = set(_STAGED)
        out = operator(*args, **kwargs)
        made = [t for path, t in _STAGED.items() if path not in before and not getattr(t, "is_kept", False)]
        if not made or [t.staged_path for t in made] == [getattr(out, "staged_path", None)]:
            return out
        result = out if hasattr(out, "staged_path") else stage_table(out)
        drop_staged(*[t for t in made if t is not result])
        return result

    return run


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def is_number(column) -> Column:
    """True where a floating column holds neither null nor NaN."""
    return column.isNotNull() & ~F.isnan(column)
