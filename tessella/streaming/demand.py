"""Request logs as an unbounded table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.logs import log_commands


def demand(log: DataFrame, lateness: str = "1 hour", period: str = "1 hour") -> DataFrame:
    """Commands per period; works on a stream and, with the same result, on a finished table.

    Repeated deliveries of an event are dropped inside the watermark.
    """
    known = log.withWatermark("ts", lateness)
    once = known.dropDuplicatesWithinWatermark(["event_id"]) if log.isStreaming else known.dropDuplicates(["event_id"])
    commands = log_commands(once)
    counts = commands.groupBy(F.window("ts", period), "command").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("period"), "command", "n")


def run_available(stream: DataFrame, path: str, checkpoint: str):
    """Write all that is there to Parquet and stop."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
