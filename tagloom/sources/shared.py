"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir. Where that is unset a local session gets a temporary folder of its own for
    it, as in tests; on a cluster it has to be set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tagloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tagloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


#: Spark's setting by which shuffle files go when a query that is written has ended, not when the driver collects its garbage.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back: what several branches of a query read is made once, and a lost
    executor takes nothing of it along. The shuffle files of the way to it are removed, so a query of many steps takes the disk
    of its largest one."""
    spark, path = df.sparkSession, fresh_dir(df.sparkSession, name)
    before = spark.conf.get(CLEANED, "false")
    spark.conf.set(CLEANED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANED, before)
    return spark.read.schema(df.schema).parquet(path)
