"""The given tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.scalars import number


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as readings: an order is a group, a line a view. `ord` orders the lines of a group totally."""
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("group_id"),
        F.format_string("%d-%d-%d", "l_linenumber", "l_partkey", "l_suppkey").alias("view"),
        place.alias("ord_key"),
        (F.col("l_linenumber") * 10**12 + F.col("l_partkey") * 10**5 + F.col("l_suppkey")).cast("long").alias("ord"),
        (F.col("l_linenumber") % 5).alias("score"),
        (F.col("l_linenumber") % 3).alias("filled"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"),
        F.year("l_shipdate").cast("string").alias("year"),
        "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate",
    )


READINGS_SQL = """
r AS (SELECT l_orderkey AS group_id, concat(l_linenumber, '-', l_partkey, '-', l_suppkey) AS view,
  CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 100000 + l_suppkey AS ord, l_linenumber % 5 AS score,
  l_linenumber % 3 AS filled, l_returnflag AS flag, l_linestatus AS status, CAST(year(l_shipdate) AS VARCHAR) AS year,
  l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_shipdate FROM lineitem)
"""


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as views: a user is a group, value the sharpness, props.k the confidence in percent."""
    k = number(F.get_json_object("props", "$.k")).cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("group_id"),
        F.col("event_id").alias("view_id"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"),
        F.col("value").alias("sharpness"),
        k.alias("k"),
        (F.col("event_id") * 37 % 400 + 1).cast("int").alias("area"),
        F.col("event_type").alias("kind"),
    )


VIEWS_SQL = """
v AS (SELECT user_id AS group_id, event_id AS view_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, value AS sharpness,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(event_id * 37 % 400 + 1 AS INTEGER) AS area,
  event_type AS kind FROM events)
"""
