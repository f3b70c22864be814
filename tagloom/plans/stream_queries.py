"""Streaming queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.plans.stand_ins import table
from tagloom.sources.shared import fresh_dir
from tagloom.streaming.votes import windowed_votes, write_once

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


@query("""WITH e AS (SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, user_id AS group_id, event_type AS value, count(*) AS votes,
max(CAST(round(value * 1000) AS BIGINT)) AS score FROM events GROUP BY ALL), t AS (SELECT max(epoch(ts)) - 3600 AS mark FROM events)
SELECT day, group_id, value, votes FROM e, t WHERE (day + 1) * 86400 <= mark
QUALIFY row_number() OVER (PARTITION BY day, group_id ORDER BY votes DESC, score DESC, value DESC) = 1""")
def streamed_votes(spark, sf_dir):
    """The votes of each day and group, from events as a stream; the last day is still open at the end and not written."""
    source = f"{sf_dir}/events.parque[t]"  # a pattern, as a stream takes no path of a single file
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(source)
    readings = events.select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("group_id"), F.lit("kind").alias("field"),
        F.col("event_type").alias("value"), F.round(F.col("value") * 1000).cast("long").alias("score"),
    )
    out = fresh_dir(spark, "votes")
    write_once(windowed_votes(readings, "1 day", "1 hour"), out, f"{out}-checkpoint")
    day = F.floor(F.unix_seconds("window_start") / 86400).alias("day")
    rows = spark.read.schema("window_start timestamp, group_id long, field string, value string, votes long").parquet(out)
    return rows.select(day, "group_id", "value", "votes")
