"""What the corpus operators share: table access, the shared scratch folder and a few column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.storage import dropped, scratch, small, stored, swept  # noqa: F401

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a text: maximal runs without \\x20 and \\x09-\\x0D."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def n_words_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def packed(docs: DataFrame) -> DataFrame:
    """All columns in one, `row`, so that a stage's own names can't meet those of the table."""
    return docs.select(F.struct(*(column(c) for c in docs.columns)).alias("row"))


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def unpacked(rows: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns of `row` again, but for those that are replaced."""
    return rows.select(*(new.get(c, F.col("row")[c]).alias(c) for c in columns))
