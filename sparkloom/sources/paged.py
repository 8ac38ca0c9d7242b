"""Deep pages of large tables: rows laid out in the order of a listing, files with known bounds, and pages by cursor or by offset.

An offset over an unordered table sorts and skips all rows before the page. Here a table is written once in order (range-sorted, files
of at most `rows_per_file` rows), with a manifest: each file's number of rows, the rows before it and its first and last keys. A page after
a cursor (the keys of the last row seen) reads only the files that hold it, wherever it is; so does a page at an offset. Order columns
are named as in listings, with a minus for descending; the last one has to be unique. Nulls come first in ascending order, last in
descending.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROWS_PER_FILE = 1_000_000


def _keys(order: tuple[str, ...]) -> list[Column]:
    return [F.desc(k[1:]) if k.startswith("-") else F.asc(k) for k in order]


def names(order: tuple[str, ...]) -> list[str]:
    return [k.removeprefix("-") for k in order]


def beyond(cursor: dict, order: tuple[str, ...], of: str = "") -> Column:
    """Whether a row's keys (below `of`, e.g. a struct's name and a dot) come after the cursor's in the order."""
    out = F.lit(False)
    for key in reversed(order):
        col, value = F.col(of + key.removeprefix("-")), cursor[key.removeprefix("-")]
        if value is None:
            past = F.lit(False) if key.startswith("-") else col.isNotNull()
        elif key.startswith("-"):
            past = (col < F.lit(value)) | col.isNull()
        else:
            past = F.coalesce(col > F.lit(value), F.lit(False))
        out = F.coalesce(past, F.lit(False)) | (col.eqNullSafe(F.lit(value)) & out)
    return out


def write(df: DataFrame, path: str, order: tuple[str, ...], rows_per_file: int = ROWS_PER_FILE, partitions: int | None = None) -> None:
    """Lays the rows out in order. Ranges are sampled, so files are of about one size but for those that are cut at rows_per_file."""
    spark, keys = df.sparkSession, _keys(order)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    laid.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/rows")
    at = F.col("_metadata.row_index")
    rows = spark.read.schema(df.schema).parquet(f"{path}/rows").select(F.col("_metadata.file_path").alias("file"), F.struct(*names(order)).alias("keys"), at.alias("at"))
    files = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min_by("keys", "at").alias("first"), F.max_by("keys", "at").alias("last"))
    # files are named by the number of their range, then of their part: a row a file
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files.withColumn("before", before).write.mode("overwrite").parquet(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/manifest")


def _read(spark: SparkSession, path: str, files: list[str]) -> DataFrame:
    schema = spark.read.parquet(f"{path}/rows").schema if files else None
    rows = [spark.read.schema(schema).parquet(f) for f in files]
    return reduce(DataFrame.unionByName, rows) if rows else spark.read.parquet(f"{path}/rows").limit(0)


def after(spark: SparkSession, path: str, order: tuple[str, ...], cursor: dict | None, limit: int) -> tuple[DataFrame, list[str]]:
    """The `limit` rows after the cursor (None: the first ones), in order, and the files that were read for them."""
    files = manifest(spark, path)
    left = files if cursor is None else files.filter(beyond(cursor, order, "last."))
    first = left.orderBy("before").select("before", "n").first()
    if first is None or limit < 1:
        return _read(spark, path, []), []
    # of the first file any number of rows may lie before the cursor
    upto = first["before"] + (first["n"] if cursor is not None else 0) + limit
    read = [r["file"] for r in left.filter(F.col("before") < upto).orderBy("before").select("file").collect()]  # as few as hold a page
    rows = _read(spark, path, read)
    return (rows if cursor is None else rows.filter(beyond(cursor, order))).orderBy(*_keys(order)).limit(limit), read


def at_offset(spark: SparkSession, path: str, order: tuple[str, ...], offset: int, limit: int) -> tuple[DataFrame, list[str]]:
    """The `limit` rows from a place on (the first is 0), and the files that were read for them."""
    files = manifest(spark, path).filter((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset))
    found = files.orderBy("before").select("file", "before").collect()  # as few as hold a page
    rows = _read(spark, path, [r["file"] for r in found])
    return rows.orderBy(*_keys(order)).offset(offset - found[0]["before"] if found else 0).limit(limit), [r["file"] for r in found]


def cursor_of(row, order: tuple[str, ...]) -> dict:
    """The cursor behind a row."""
    return {k: row[k] for k in names(order)}
