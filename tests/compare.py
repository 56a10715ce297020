"""Compare a query with its SQL counterpart: ``python -m tests.compare SF_DIR NAME...``"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings commits changes "
    "author_aliases knowledge_shares strata blobs eval_items"
).split()


def session(cores: int = 8, partitions: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", "/tmp/tidemark-warehouse")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def oracle(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        file = Path(sf_dir, f"{name}.parquet")
        if file.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{file}')")
    return con


def plain(value):
    """A value in a form that both engines share."""
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if hasattr(value, "as_tuple"):
        value = float(value) if value != value.to_integral_value() else int(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return float(f"{value:.9g}") + 0.0
    if isinstance(value, int):
        return float(f"{value:.9g}") if abs(value) > 2**53 else value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if hasattr(value, "isoformat"):
        return value.replace(tzinfo=None).isoformat() if hasattr(value, "hour") else value.isoformat()
    return value


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(plain(r[k]) for k in order) for r in rows)


def difference(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty if both give the same rows, otherwise what differs."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = rows_of(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if got != want:
        return f"{sum(got.values())} rows against {sum(want.values())}; only here {list((got - want).items())[:3]}; only in SQL {list((want - got).items())[:3]}"
    return "" if got else "no rows"


def main(sf_dir: str, names: list[str]) -> int:
    import __spark_entry__ as entry

    spark, con, bad = session(), oracle(sf_dir), 0
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in names or sorted(queries):
        began = time.time()
        try:
            if name in sql:
                why = difference(spark, con, queries[name], sql[name], sf_dir)
            else:
                n = queries[name](spark, sf_dir).count()
                why = "" if n else "no rows"
                name = f"{name} ({n} rows, no SQL)"
        except Exception as error:  # noqa: BLE001
            why = f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{name}: {why or 'same'} in {time.time() - began:.1f} s", flush=True)
        bad += bool(why) and why != "no rows"
    return bad


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1], sys.argv[2:])))
