"""Intermediate tables in the folder that driver and executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 8 << 20


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder. Where none is set, a local session gets a temporary one; a cluster has to name its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, survives lost executors, gives the planner true sizes."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more, and what finished jobs left."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        swept(tables[0].sparkSession)


def swept(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of finished jobs: its cleaner does so for what the driver's garbage collector has found."""
    spark._jvm.System.gc()


def small(df: DataFrame) -> DataFrame:
    """A stored table for a join: sent to all tasks if its counted rows take BROADCAST_BYTES at most, else left to the planner (a shuffle)."""
    width = 24 + sum(8 if f.dataType.typeName() in ("long", "integer", "double", "boolean") else 64 for f in df.schema)
    return F.broadcast(df) if df.count() * width <= BROADCAST_BYTES else df
