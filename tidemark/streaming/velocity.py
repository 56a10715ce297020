"""Change velocity over a stream of changes, with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "rev string, path string, canonical_author string, date timestamp, loc_added int, loc_deleted int"


def change_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Changes that arrive as JSON-lines files in a folder."""
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(folder)


def distinct_changes(changes: DataFrame, late: str = "7 days") -> DataFrame:
    """Changes without repeats; a repeat is known for as long as the watermark allows."""
    return changes.withWatermark("date", late).dropDuplicatesWithinWatermark(["rev", "path"])


def _marked(changes: DataFrame, late: str | None) -> DataFrame:
    return changes.withWatermark("date", late) if late else changes


def windowed_velocity(changes: DataFrame, size: str = "30 days", slide: str = "10 days", late: str | None = "7 days") -> DataFrame:
    """Revisions and lines per path and sliding window; windows are final once the watermark passes.

    ``late=None`` keeps the watermark that the stream already has.
    """
    counted = _marked(changes, late).groupBy(F.window("date", size, slide).alias("w"), "path")
    return counted.agg(F.count(F.lit(1)).alias("revisions"), F.sum(F.greatest(F.coalesce("loc_added", F.lit(0)), F.lit(0))).alias("added")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "path", "revisions", "added"
    )


def author_sessions(changes: DataFrame, gap: str = "2 hours", late: str | None = "7 days") -> DataFrame:
    """Working sessions of authors: changes with no longer pause than ``gap``; ``late`` as above."""
    counted = _marked(changes, late).groupBy(F.session_window("date", gap).alias("w"), "canonical_author")
    return counted.agg(F.count(F.lit(1)).alias("changes")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "canonical_author", "changes")


def append_to(stream: DataFrame, path: str, checkpoint: str):
    """Append a stream to a Parquet folder, all that is there, and stop."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
