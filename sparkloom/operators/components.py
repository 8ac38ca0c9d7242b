"""Connected components of an edge table by rounds of least-label exchange and pointer jumping, each round stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.storage import stored


def components(edges: DataFrame) -> DataFrame:
    """id, label (the smallest id reachable) of every end of an edge; edges: a, b. No row per component meets in one task:
    neighbours' labels are reduced before each shuffle. Null ends are dropped; loops and repeated edges do no harm."""
    edges = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("m"))
        seen = labels.join(near, labels["id"] == near["a"], "left").select("id", F.col("label").alias("was"), F.least("label", F.coalesce("m", "label")).alias("l"))
        up = labels.select(F.col("id").alias("l"), F.col("label").alias("up"))
        moved = stored(seen.join(up, "l", "left").select("id", "was", F.least("l", F.coalesce("up", "l")).alias("label")))
        labels = moved.select("id", "label")
        if moved.filter(F.col("was") != F.col("label")).isEmpty():
            return labels
