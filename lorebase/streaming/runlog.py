"""Run-log metrics over a stream; an extension, as the corpus itself is not a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_runs(events: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Runs, their mean latency and largest latency per window and outcome; rows later than ``late`` are dropped."""
    at = F.col(time).cast("timestamp")
    return (
        events.withColumn("at", at)
        .withWatermark("at", late)
        .groupBy(F.window("at", width), "outcome")
        .agg(F.count(F.lit(1)).alias("runs"), F.avg("latency_ms").alias("mean_ms"), F.max("latency_ms").alias("max_ms"))
    )


def sessions(events: DataFrame, by: str = "user_id", key: str = "trace_id", time: str = "ts", late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """(``by``, start, end, runs, mean_ms, refused) of each session: runs of one user with less than ``gap`` between them.

    A run that comes again (same ``key``) within the delay counts once, whichever micro-batch brings it; rows later than
    ``late`` are dropped.  A session is given once, when the watermark has passed its end: no state outlives that.
    """
    once = events.withColumn("at", F.col(time).cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark([key])
    grouped = once.groupBy(by, F.session_window("at", gap).alias("session")).agg(F.count(F.lit(1)).alias("runs"), F.avg("latency_ms").alias("mean_ms"), F.count_if("refused").alias("refused"))
    return grouped.select(by, F.col("session.start").alias("start"), F.col("session.end").alias("end"), "runs", "mean_ms", "refused")
