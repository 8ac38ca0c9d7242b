"""Joins, set operations and ordered rules over the audit tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.storage import stored


def session_children(runs: DataFrame, agents: DataFrame) -> DataFrame:
    return runs.select("session_id", "request_id").join(agents.select("request_id", "step_index", "agent_id", "id"), "request_id").select("session_id", "request_id", "step_index", "agent_id", "id")


def known(rows: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """The rows with `known`: whether the key exists."""
    have = existing.select(key).distinct().withColumn("known", F.lit(True))
    return rows.join(have, key, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def review_chain(reviews: DataFrame) -> DataFrame:
    """id, root, depth: each review's first source, however far. Pointer jumping: each round doubles the links that are looked through.

    A review whose source is unknown is a root; reviews that lead into a circle have no root and are left out. Roots are told apart
    once, and links that lead to one are settled: a round has the open links meet the links that aren't roots, and no others."""
    links = reviews.select("id", F.col("source_review_id").alias("up"))
    known = links.select(F.col("id").alias("up"), F.lit(True).alias("known")).distinct()
    has = F.coalesce("known", F.lit(False))
    at = stored(links.filter("up IS NOT NULL").join(known, "up", "left").select("id", "up", has.alias("known")))
    roots = links.filter("up IS NULL").select("id").unionByName(at.filter("NOT known").select("id"))
    # rows that aren't roots: where they lead, how far that is, and whether it is a root
    ends = roots.select(F.col("id").alias("up"), F.lit(True).alias("done"))
    at = stored(at.filter("known").join(ends, "up", "left").select("id", F.col("up").alias("root"), F.lit(1).cast("long").alias("depth"), F.coalesce("done", F.lit(False)).alias("done")))
    for _ in range(math.ceil(math.log2(max(2, at.count()))) + 1):
        left = at.filter("NOT done")
        if left.isEmpty():
            break
        further = at.select(F.col("id").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"), F.col("done").alias("ends"))
        moved = left.drop("done").join(further, "root").select("id", F.col("next").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), F.col("ends").alias("done"))
        at = stored(at.filter("done").unionByName(moved))
    rows = at.filter("done").select("id", "root", F.col("depth").cast("int").alias("depth"))
    return roots.select("id", F.col("id").alias("root"), F.lit(0).alias("depth")).unionByName(rows)


def owner(submissions: DataFrame, workflows: DataFrame) -> DataFrame:
    """request_id, owner: the submission's user, else the one in the workflow's metadata. Here every third user is unset."""
    own = F.when(F.col("user_id") % 3 != 0, F.col("user_id").cast("string"))
    meta = workflows.select("request_id", F.get_json_object("metadata_payload", "$.user_id").alias("other"))
    return submissions.join(meta, "request_id", "left").select("request_id", F.coalesce(own, "other").alias("owner"))


def last_wins(rows: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """The last row of each key."""
    last = Window.partitionBy(key).orderBy(*map(F.desc, order))
    return rows.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r")


def invalid_transitions(steps: DataFrame) -> DataFrame:
    """Steps (review_id, ord, status) that aren't pending to approved or rejected."""
    before = F.lag("status").over(Window.partitionBy("review_id").orderBy("ord"))
    allowed = (F.col("before") == "pending") & F.col("status").isin("approved", "rejected")
    return steps.withColumn("before", before).filter(F.col("before").isNotNull() & ~allowed).drop("before")


def breaker(calls: DataFrame, failures: int = 3) -> DataFrame:
    """key, opened_at: where the circuit of a key first opens: at a quota error, or the n-th failure in a row (key, id, outcome)."""
    order = Window.partitionBy("key").orderBy("id")
    row = F.col("outcome") == "failed"
    for k in range(1, failures):
        row = row & (F.lag("outcome", k).over(order) == "failed")
    return calls.withColumn("opens", (F.col("outcome") == "quota") | row).filter("opens").groupBy("key").agg(F.min("id").alias("opened_at"))


def over_step_limit(agents: DataFrame, most: int) -> DataFrame:
    return agents.groupBy("request_id").agg(F.count(F.lit(1)).alias("steps")).filter(F.col("steps") > most)


def refreshed(submissions: DataFrame, states: DataFrame) -> DataFrame:
    """Submissions in a pending state take the new status, if there is one; the others keep theirs."""
    rows = submissions.join(states.select("request_id", "new_status"), "request_id", "left")
    open_ = F.col("status").isin("pending", "received", "started", "retry")
    return rows.select("task_id", F.when(open_, F.coalesce("new_status", "status")).otherwise(F.col("status")).alias("status"))


def patched(rows: DataFrame, patch: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """Fields that the patch has, and that aren't null there, replace the row's."""
    new = patch.select(key, *(F.col(f).alias(f"_{f}") for f in fields))
    joined = rows.join(new, key, "left")
    for f in fields:
        joined = joined.withColumn(f, F.coalesce(f"_{f}", f)).drop(f"_{f}")
    return joined


def distinct_in_order(rows: DataFrame, key: str, value: str, order: tuple[str, ...]) -> DataFrame:
    """key, value: a key's distinct values in order of first appearance, comma-joined."""
    listed = F.array_sort(F.collect_list(F.struct(*order, value)))
    return rows.groupBy(key).agg(F.array_join(F.array_distinct(F.transform(listed, lambda x: x[value])), ",").alias(value))


def merged_metadata(old: Column, new: Column) -> Column:
    """{**old, **new} of two maps; the new one's values win."""
    kept = F.map_filter(old, lambda k, _: ~F.coalesce(F.map_contains_key(new, k), F.lit(False)))
    return F.map_concat(F.coalesce(kept, F.create_map().cast("map<string,string>")), F.coalesce(new, F.create_map().cast("map<string,string>")))
