"""Counts and sums over the audit tables: run details, dashboards, recent windows, queues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """part / whole; null when whole is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def run_details(runs: DataFrame, agents: DataFrame, tools: DataFrame, calls: DataFrame) -> DataFrame:
    """Each run with its numbers of agent, tool and call rows; tokens of successful calls only, cost of all, six places.

    Each side is summed by request before it is joined, so sides don't multiply each other."""
    a = agents.groupBy("request_id").agg(F.count(F.lit(1)).alias("agent_runs"))
    t = tools.groupBy("request_id").agg(F.count(F.lit(1)).alias("tool_calls"))
    tokens = F.sum(F.when(F.col("status") == "success", F.col("total_tokens")).otherwise(0))
    c = calls.groupBy("request_id").agg(F.count(F.lit(1)).alias("llm_calls"), tokens.alias("tokens"), F.sum("cost_usd").alias("cost"))
    rows = runs.join(a, "request_id", "left").join(t, "request_id", "left").join(c, "request_id", "left")
    zero = lambda n: F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias(n)
    return rows.select(
        "request_id", "session_id", "created_at", "status", zero("agent_runs"), zero("tool_calls"), zero("llm_calls"), zero("tokens"), F.round(F.coalesce("cost", F.lit(0.0)), 6).alias("cost")
    )


def session_details(details: DataFrame, newest: int | None = None) -> DataFrame:
    """Run details summed by session, over all its runs or the newest ones only."""
    if newest is not None:
        order = Window.partitionBy("session_id").orderBy(F.desc("created_at"), "request_id")
        details = details.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= newest)
    sums = [F.sum(c).cast("bigint").alias(c) for c in ("agent_runs", "tool_calls", "llm_calls", "tokens")]
    return details.groupBy("session_id").agg(F.count(F.lit(1)).alias("task_runs"), *sums, F.round(F.sum("cost"), 6).alias("cost"))


def counts_by(df: DataFrame, key: str, label: str) -> DataFrame:
    """label, key, n of each value that isn't null."""
    rows = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.lit(label).alias("measure"), "key", "n")


def total_of(df: DataFrame, label: str, condition: Column | None = None) -> DataFrame:
    n = F.count(F.lit(1)) if condition is None else F.count_if(condition)
    return df.agg(n.alias("n")).select(F.lit(label).alias("measure"), F.lit("all").alias("key"), "n")


STATES = {"task_runs": ("status",), "tool_calls": ("status",), "workflow_runs": ("status",), "reviews": ("status",), "memories": ("scope", "source")}
LINKS = {"reviews": ("continuation_request_id", "source_review_id")}


def dashboard(tables: dict[str, DataFrame]) -> DataFrame:
    """measure, key, n: the totals of every table and its counts by state, in one table. Each table is counted once, by all its states; the
    figures are sums of these few cells."""
    n, parts = F.coalesce(F.sum("n"), F.lit(0)).alias("n"), []
    for name, df in tables.items():
        states, links = STATES.get(name, ()), LINKS.get(name, ())
        cells = df.groupBy(*states, *(F.col(c).isNotNull().alias(c) for c in links)).agg(F.count(F.lit(1)).alias("n"))
        total = lambda rows, label: rows.agg(n).select(F.lit(label).alias("measure"), F.lit("all").alias("key"), "n")
        parts.append(total(cells, name))
        for c in states:
            by = cells.filter(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("key")).agg(n)
            parts.append(by.select(F.lit(f"{name}_by_{c}").alias("measure"), "key", "n"))
        parts += [total(cells.filter(c), f"with_{c}") for c in links]
    return reduce(DataFrame.unionByName, parts)


def recent_tool_stats(tools: DataFrame, newest: int = 500) -> DataFrame:
    """measure, key, n over the newest tool calls: truthy error categories, retryable ones, knowledge searches and their results."""
    rows = tools.orderBy(F.desc("created_at"), "id").limit(newest)
    category = F.nullif(F.get_json_object("metrics", "$.error_category"), F.lit(""))
    errors = rows.select(category.alias("key")).filter("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    search = F.col("tool_name") == "knowledge_search"
    results = F.coalesce(F.json_array_length(F.get_json_object("content", "$.results")), F.lit(0))
    sums = rows.agg(
        F.count_if(F.get_json_object("metrics", "$.retryable") == "true").alias("retryable"),
        F.count_if(search).alias("searches"),
        F.coalesce(F.sum(F.when(search, results)), F.lit(0)).cast("bigint").alias("results"),
    )
    flat = sums.select(F.expr("stack(3, 'retryable', retryable, 'searches', searches, 'results', results) AS (key, n)")).select(F.lit("total").alias("measure"), "key", "n")
    return errors.select(F.lit("error_category").alias("measure"), "key", "n").unionByName(flat)


def retrieved_summary(tools: DataFrame) -> DataFrame:
    """request_id, hits, refs (distinct, in order), backends (distinct, sorted) of the knowledge searches of each request."""
    rows = tools.filter(F.col("tool_name") == "knowledge_search").select(
        "request_id",
        "id",
        F.get_json_object("content", "$.hits").cast("int").alias("hits"),
        F.get_json_object("content", "$.backend").alias("backend"),
        F.from_json(F.get_json_object("content", "$.results"), "array<int>").alias("results"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("id", "results")))
    return rows.groupBy("request_id").agg(
        F.sum("hits").cast("bigint").alias("hits"),
        F.array_join(F.array_distinct(F.flatten(F.transform(ordered, lambda x: x["results"]))), ",").alias("refs"),
        F.array_join(F.sort_array(F.collect_set("backend")), ",").alias("backends"),
    )


def queue_summary(backlog: DataFrame) -> DataFrame:
    """ready (sum), unacked (sum), oldest age of the reachable queues."""
    ok = backlog.filter("reachable")
    return ok.agg(F.coalesce(F.sum("ready"), F.lit(0)).cast("bigint").alias("ready"), F.coalesce(F.sum("unacked"), F.lit(0)).cast("bigint").alias("unacked"), F.max("oldest_unacked_age_seconds").alias("oldest"))


def worker_inventory(ping: DataFrame, stats: DataFrame, queues: DataFrame) -> DataFrame:
    """Every worker that any of the three replies names, with what each says of it."""
    return ping.join(stats, "worker", "full").join(queues, "worker", "full").select("worker", F.coalesce("alive", F.lit(False)).alias("alive"), "pool_size", "queue")


def stalled(reachable: Column, ready: Column, unacked: Column, age: Column, visibility: Column) -> Column:
    """Whether a queue's work isn't taken: reachable, and something ready, or unacked work older than the visibility time."""
    return F.when(~reachable, False).when(ready > 0, True).when(unacked == 0, False).when(age.isNull(), False).otherwise(age > visibility)


def worker_status(reachable: Column, live: Column, stale: Column, is_stalled: Column) -> Column:
    """degraded, ready, stalled or offline, in this order of precedence; a stalled queue overrides all but degraded."""
    return F.when(~reachable, "degraded").when(is_stalled, "stalled").when(live > 0, "ready").when(stale > 0, "stalled").otherwise("offline")


def heartbeats(beats: DataFrame, now: Column, stale_after: float) -> DataFrame:
    """The latest beat of each worker, its age (0 at least) and whether it is stale. Rows without id or time are malformed and skipped."""
    last = Window.partitionBy("worker_id").orderBy(F.desc("beat_at"))
    rows = beats.filter("worker_id IS NOT NULL AND beat_at IS NOT NULL").withColumn("r", F.row_number().over(last)).filter("r = 1").drop("r")
    age = F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("beat_at").cast("timestamp"))) / 1e6)
    return rows.withColumn("age", age).withColumn("stale", F.col("age") > stale_after)
