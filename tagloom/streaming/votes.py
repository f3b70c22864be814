"""Votes over streams of readings: a window's result is written once, when the watermark has passed it.

State holds a counter for each value seen in the windows still open, not the readings, and leaves with the watermark. Two
chained aggregations run in one query: counters of values, then the winner of each group and field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_votes(readings: DataFrame, width: str, delay: str) -> DataFrame:
    """window_start, group_id, field, value, votes: the most frequent value of each window, group and field; ties go to
    the higher score, then to the greater value.

    readings: ts, group_id, field, value, score. Readings without a value don't vote; those later than `delay` after the
    newest one are too late for a window that was written. Works on a stream (append mode) and on a table alike."""
    known = readings.where(F.coalesce(F.col("value") != "", F.lit(False))).withWatermark("ts", delay)
    counted = known.groupBy(F.window("ts", width).alias("w"), "group_id", "field", "value").agg(
        F.count(F.lit(1)).alias("votes"), F.max("score").alias("score")
    )
    won = counted.groupBy(F.window(F.window_time("w"), width).alias("window"), "group_id", "field").agg(
        F.max(F.struct("votes", "score", "value")).alias("m")
    )
    return won.select(F.col("window.start").alias("window_start"), "group_id", "field", "m.value", "m.votes")


def write_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Processes what there is of a stream in bounded batches and stops; a restart goes on from the checkpoint, and the
    file sink holds each batch once."""
    running = stream.writeStream.format("parquet").outputMode("append").option("path", path)
    running.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
