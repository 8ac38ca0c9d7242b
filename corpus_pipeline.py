"""The corpus pipeline: quality rules, line dedup, near duplicates, mixing, encoding.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a table, which is written as Parquet and read
again as the next one's docs. All stages but the last return the columns of `documents`.

1. quality_rules: documents that the rules reject go, and of the others the lines that recur on their host, save in the first.
2. line_dedup: lines of recurring templates go, from all documents but the template's first.
3. near_duplicates: of each component of documents that are alike (5-word shingles, similarity 0.8 or more), the smallest doc_id stays.
4. mixing: each document's row as often as the mix takes it.
5. bpe: the rows' token ids.

Each stage begins by letting Spark remove the shuffle files that earlier ones left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bpe, jaccard_join, line_dedup, mixing, quality_rules
from sparkloom.llm._base import documents, stored
from sparkloom.session import ship
from sparkloom.storage import swept


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    swept(spark)
    return quality_rules.cleaned(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    swept(spark)
    return line_dedup.deduped(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    swept(spark)
    return jaccard_join.deduped(docs, n=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    swept(spark)
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    swept(spark)
    return bpe.encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("mixing", mix), ("bpe", encode)]
#: Encoding and merging of tokens can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(ship(spark), sf_dir)
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
