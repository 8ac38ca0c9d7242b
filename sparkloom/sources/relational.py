"""Tables of a relational database over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, url: str, table: str, key: str | None = None, partitions: int = 32, where: str | None = None, columns: list[str] | None = None, fetch: int = 10_000, **options) -> DataFrame:
    """A table, read in `partitions` ranges of a numeric, date or timestamp key, whose bounds the database finds; without a key by one task.
    The condition (Spark SQL) and the columns reach the database; rows with a null key are read, too."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("fetchsize", fetch).options(**options)
    narrow = lambda df: df.filter(where) if where else df
    if key:
        # aggregates are pushed down, so one row comes back
        ends = narrow(reader.load()).agg(F.min(key).cast("string").alias("lo"), F.max(key).cast("string").alias("hi")).first()
        if ends["lo"] is not None and ends["lo"] != ends["hi"]:
            reader = reader.option("partitionColumn", key).option("lowerBound", ends["lo"]).option("upperBound", ends["hi"]).option("numPartitions", partitions)
    rows = narrow(reader.load())
    return rows.select(*columns) if columns else rows


def write_table(df: DataFrame, url: str, table: str, mode: str = "append", batch: int = 5_000, **options) -> None:
    df.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", batch).options(**options).mode(mode).save()
