"""Streams over the attempt log: counts by day and verdict, and charges once.

Each takes a streaming table and returns one; ``drain`` runs what has arrived, with its
progress in a checkpoint folder, so a run that was cut off goes on where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATE = "1 hour"


def verdict_counts(attempts: DataFrame, late: str = LATE) -> DataFrame:
    """STR-02: attempts and credits by UTC day and verdict; rows later than ``late`` are left out."""
    day = F.window("attempted_at", "1 day")
    counted = attempts.withWatermark("attempted_at", late).groupBy(day, "verdict").agg(F.count("*").alias("attempts"), F.sum("cost_credits").alias("credits"))
    return counted.select(F.col("window.start").alias("day"), "verdict", "attempts", "credits")


def dedupe_charges(charges: DataFrame, late: str = LATE) -> DataFrame:
    """STR-03: the first charge of each request_id within the watermark of event_at."""
    return charges.withWatermark("event_at", late).dropDuplicatesWithinWatermark(["request_id"])


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append what the stream finishes by now to Parquet files at ``path``."""
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start().awaitTermination()
