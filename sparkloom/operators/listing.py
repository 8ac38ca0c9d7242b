"""Filtered, ordered and paged listings of the audit tables, with their totals."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def json_true(payload: str, path: str) -> Column:
    """Whether a JSON field is true; a missing one is false."""
    return F.coalesce(F.get_json_object(payload, path) == "true", F.lit(False))


@dataclass(frozen=True)
class Listing:
    """A table's filters, order and default page size. A filter that is None isn't applied; `derived` gives the column behind a
    filter that isn't one of the table's own; with `truthy`, empty values aren't applied either."""

    filters: tuple[str, ...]
    order: tuple[str, ...]
    limit: int
    derived: dict = field(default_factory=dict)
    truthy: bool = False

    def matching(self, df: DataFrame, **values) -> DataFrame:
        for name, value in values.items():
            if name not in self.filters:
                raise ValueError(f"no filter {name!r}")
            if value is None or (self.truthy and not value):
                continue
            column = self.derived[name]() if name in self.derived else F.col(name)
            df = df.filter(column == F.lit(value))
        return df

    def page(self, df: DataFrame, limit: int | None = None, offset: int = 0, **values) -> DataFrame:
        """A page in order; the order ends with a unique key, so pages never overlap."""
        keys = [F.desc(k[1:]) if k.startswith("-") else F.asc(k) for k in self.order]
        rows = self.matching(df, **values).orderBy(*keys)
        return (rows.offset(offset) if offset else rows).limit(self.limit if limit is None else limit)

    def total(self, df: DataFrame, **values) -> DataFrame:
        """One row: how many match before paging."""
        return self.matching(df, **values).agg(F.count(F.lit(1)).alias("total"))


LISTINGS = {
    "sessions": Listing(("session_id", "user_id", "status"), ("-created_at", "id"), 20),
    "task_runs": Listing(("status", "session_id", "workflow_id"), ("-created_at", "id"), 20),
    "agent_runs": Listing(("request_id", "agent_id", "status"), ("-created_at", "step_index", "id", "part_id"), 100),
    "tool_calls": Listing(
        ("agent_id", "tool_name", "status", "request_id", "error_category", "retryable"),
        ("-created_at", "id"),
        100,
        {"error_category": lambda: F.get_json_object("metrics", "$.error_category"), "retryable": lambda: json_true("metrics", "$.retryable")},
    ),
    "calls": Listing(("request_id", "agent_id", "status", "user_id", "model"), ("-created_at", "id"), 100),
    "workflow_runs": Listing(("request_id", "status", "user_id"), ("-created_at", "id"), 20, {"user_id": lambda: F.get_json_object("metadata_payload", "$.user_id")}),
    "submissions": Listing(("status", "request_id", "session_id", "user_id"), ("-created_at", "task_id"), 20),
    "reviews": Listing(("status", "user_id"), ("-created_at", "id"), 50, truthy=True),
    "memories": Listing(("scope", "scope_key", "memory_type"), ("-importance", "-created_at", "id"), 50),
    "model_pool": Listing(("enabled",), ("sort_order", "name"), 100),
    "users": Listing((), ("created_at", "id"), 2**31 - 1),
}


def overdue(reviews: DataFrame, now: Column, newest: int | None = 200, after_minutes: int = 30, within_hours: int = 24) -> DataFrame:
    """Pending reviews created in [now - within, now - after], the older end open; of the newest ones, or of all with newest=None."""
    rows = reviews.filter(F.col("status") == "pending")
    if newest is not None:
        rows = rows.orderBy(F.desc("created_at"), "id").limit(newest)
    low, high = now - F.expr(f"INTERVAL {within_hours} HOURS"), now - F.expr(f"INTERVAL {after_minutes} MINUTES")
    return rows.filter((F.col("created_at") > low) & (F.col("created_at") <= high))


def scoped(df: DataFrame, user: str | None, is_admin: bool, column: str = "user_id") -> DataFrame:
    """A member's own rows; an administrator's are all."""
    return df if is_admin else df.filter(F.col(column) == F.lit(user))


#: Workflow states that a result may carry.
STATUSES = ("pending", "running", "completed", "failed", "needs_human_review", "cancelled")
REASONS = ("completed", "failed", "human_review", "max_steps", "cancelled")


def workflow_status(status: str = "status", payload: str = "result_payload") -> Column:
    own = F.get_json_object(payload, "$.status")
    s = F.col(status)
    return (
        F.when(s == "pending", "pending")
        .when(s.isin("received", "started", "retry"), "running")
        .when(s == "failure", "failed")
        .when(s == "success", F.when(own.isin(*STATUSES), own).otherwise("completed"))
    )


def terminal_reason(payload: str = "result_payload") -> Column:
    own = F.get_json_object(payload, "$.terminal_reason")
    return F.when(own.isin(*REASONS), own)


def review_id(payload: str = "result_payload") -> Column:
    return F.nullif(F.get_json_object(payload, "$.review_id"), F.lit(""))


def tool_call_response(calls: DataFrame) -> DataFrame:
    """The JSON metrics as typed columns."""
    m = lambda p, t: F.get_json_object("metrics", p).cast(t)
    return calls.select(
        "id", "request_id", "tool_name", "status", m("$.error_category", "string").alias("error_category"),
        json_true("metrics", "$.retryable").alias("retryable"), m("$.latency_ms", "long").alias("latency_ms"),
    )


def newest(messages: DataFrame, limit: int, keys: tuple[str, ...] = ("session_id",), order: tuple[str, ...] = ("step_index", "id")) -> DataFrame:
    """The newest `limit` messages of each session, to be read oldest first by `position`."""
    back = Window.partitionBy(*keys).orderBy(*map(F.desc, order))
    forth = Window.partitionBy(*keys).orderBy(*map(F.asc, order))
    return messages.withColumn("back", F.row_number().over(back)).filter(F.col("back") <= limit).withColumn("position", F.row_number().over(forth)).drop("back")


def message_page(messages: DataFrame, limit: int, offset: int = 0, legacy: bool = False) -> DataFrame:
    """A page of one session's messages in order. legacy: the newest limit + offset ascending, from the offset-th on."""
    if not legacy:
        return messages.orderBy("step_index", "id").offset(offset).limit(limit)
    return messages.orderBy(F.desc("step_index"), F.desc("id")).limit(limit + offset).orderBy("step_index", "id").offset(offset)


def transcript(messages: DataFrame, turns: int, clip: int) -> DataFrame:
    """session_id, transcript: the last `turns` messages, then only those of user and assistant, clipped, in order."""
    rows = newest(messages, turns).filter(F.col("role").isin("user", "assistant"))
    line = F.concat(F.col("role"), F.lit(": "), F.substring("content", 1, clip)).alias("line")
    lines = F.array_sort(F.collect_list(F.struct("position", line)))
    return rows.groupBy("session_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("transcript"))


def recall(memories: DataFrame, top_k: int, scopes: dict[str, str]) -> DataFrame:
    """The top_k most important memories of each scope, in the order user, project, global; the global one is always in."""
    wanted = F.col("scope") == "global"
    for scope, key in scopes.items():
        wanted = wanted | ((F.col("scope") == scope) & (F.col("scope_key") == key))
    place = F.when(F.col("scope") == "user", 0).when(F.col("scope") == "project", 1).otherwise(2)
    order = Window.partitionBy("scope").orderBy(F.desc("importance"), F.desc("created_at"), "id")
    return memories.filter(wanted).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k).withColumn("scope_rank", place)


def first_entry(pool: DataFrame) -> DataFrame:
    """The default entry: enabled, marked default, first by sort_order and name."""
    return pool.filter("enabled AND is_default").orderBy("sort_order", "name").limit(1)


def one_default(pool: DataFrame, order: str = "id") -> DataFrame:
    """At most one default: the last marked one (`order` is unique). One row, its place, goes to all tasks."""
    last = pool.filter("is_default").agg(F.max(order).alias("_last"))
    return pool.crossJoin(F.broadcast(last)).withColumn("is_default", F.col("is_default") & F.coalesce(F.col(order) == F.col("_last"), F.lit(False))).drop("_last")


def review_links(runs: DataFrame) -> DataFrame:
    """request_id, review_id (only while a run waits for review), source_review_id."""
    return runs.select("request_id", F.when(F.col("status") == "needs_human_review", F.col("review_id")).alias("review_id"), "source_review_id")
