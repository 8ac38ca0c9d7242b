"""Connected components of links that come in several lots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._base import stored
from sparkloom.operators.components import components


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """p, label after further links (a, b) between points: components that are known already count as one point each."""
    links = links.select("a", "b")
    if labels is not None:
        for k in ("a", "b"):
            links = links.join(labels.select(F.col("p").alias(k), F.col("label").alias(f"_{k}")), k, "left").withColumn(k, F.coalesce(f"_{k}", k)).drop(f"_{k}")
    new = components(links)
    if labels is None:
        return new.withColumnRenamed("id", "p")
    up = new.select(F.col("id").alias("label"), F.col("label").alias("up"))
    old = labels.join(up, "label", "left").select("p", F.coalesce("up", "label").alias("label"))
    return stored(old.unionByName(new.withColumnRenamed("id", "p").join(labels.select("p"), "p", "left_anti")))
