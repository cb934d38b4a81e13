"""The per-path tally over a stream of change events.

A stream of (path, author_idx, kind, time) keeps one row of state a path and author; late or
repeated micro-batches update counts exactly once with a checkpoint location. The reports'
roll-up runs over the table that the stream keeps up to date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tally_stream(events: DataFrame) -> DataFrame:
    """Streaming (path, author_idx): n, last; write it in update or complete mode."""
    live = events.filter("kind != 'Deleted'")
    return live.groupBy("path", "author_idx").agg(F.count("*").alias("n"), F.max("time").alias("last"))


def daily_changes(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Streaming changes a day and top-level folder, with a watermark on ``at`` (timestamp): append mode."""
    from ..functions.columns import top_level

    live = events.filter("kind != 'Deleted'").withColumn("top", top_level(F.col("path")))
    return live.withWatermark("at", late).groupBy(F.window("at", "1 day"), "top").agg(F.count("*").alias("n"))
