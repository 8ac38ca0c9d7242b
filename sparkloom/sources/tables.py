"""Tables that are changed as wholes: each change is written as a new version (a folder of Parquet files), and the newest finished version is
the table. A job that fails leaves an unfinished version, which nobody reads; one that runs again gives the same table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the finished versions."""
    fs, where = _files(spark, path)
    if not fs.exists(where):
        return []
    found = [s.getPath() for s in fs.listStatus(where) if s.getPath().getName().startswith("v")]
    done = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(int(p.getName()[1:]) for p in found if fs.exists(done(p, "_SUCCESS")))


def exists(spark: SparkSession, path: str) -> bool:
    return bool(versions(spark, path))


def read(spark: SparkSession, path: str) -> DataFrame:
    found = versions(spark, path)
    if not found:
        raise ValueError(f"no table at {path}")
    return spark.read.parquet(f"{path}/v{found[-1]}")


def _claimed(spark: SparkSession, path: str) -> int:
    """The number of a new version, which no other writer gets: its claim is a file that is made only if it isn't there."""
    number = max(versions(spark, path), default=0) + 1
    while True:
        fs, where = _files(spark, f"{path}/claims/v{number}")
        try:
            fs.create(where, False).close()
            return number
        except Exception as e:
            if "already exists" not in str(e):
                raise
            number += 1


def replace(df: DataFrame, path: str, keep: int = 2) -> None:
    """df becomes the table; the last `keep` versions stay, for those who still read them."""
    spark = df.sparkSession
    df.write.parquet(f"{path}/v{_claimed(spark, path)}")
    fs, where = _files(spark, path)
    for old in versions(spark, path)[:-keep]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(where, f"v{old}"), True)


def merge(new: DataFrame, path: str, keys: list[str], order: str | None = None) -> None:
    """Rows replace those of equal keys (null equals null); of repeated new rows the last by `order`, else any, stays."""
    spark = new.sparkSession
    rows = new
    if order:
        best = F.max_by(F.struct(*new.columns), order).alias("_row")
        rows = new.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(best).select("_row.*")
    else:
        rows = new.dropDuplicates(keys)
    if exists(spark, path):
        rows = rows.unionByName(without(read(spark, path), new, keys), allowMissingColumns=True)
    replace(rows, path)


def without(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys aren't among those gone."""
    other = gone.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    same = [table[k].eqNullSafe(other[f"_{k}"]) for k in keys]
    return table.join(other, same, "left_anti")


def delete(gone: DataFrame, path: str, keys: list[str]) -> None:
    """Deletes the rows of these keys; a table that doesn't exist has none."""
    spark = gone.sparkSession
    if exists(spark, path):
        replace(without(read(spark, path), gone, keys), path)


def reset(spark: SparkSession, path: str) -> None:
    """Removes a table and its versions."""
    fs, where = _files(spark, path)
    fs.delete(where, True)


def count(spark: SparkSession, path: str, statistics: DataFrame | None = None) -> int:
    """Rows of the table; where it can't be read, what the statistics (one row: n) last said, else 0."""
    try:
        return read(spark, path).count()
    except Exception:
        if statistics is None:
            return 0
        row = statistics.select(F.max("n").alias("n")).first()
        return int(row["n"] or 0)
