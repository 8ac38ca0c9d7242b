"""Usage rollups: calls, tokens, cost and failures over grouping sets."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usage_report(
    calls: DataFrame,
    model: str = "model",
    user: str = "user_id",
    failed: Column | None = None,
    limits: dict[str, int] | None = None,
) -> DataFrame:
    """Totals, and figures by model, by user and by both, from one aggregation of the calls by both keys.

    A null user is a bucket of its own, told from the totals by grouping_id(). The totals row exists for an empty table.
    Groups are ranked by tokens (descending), then by key; `limits` keeps the first rows of a grouping. With limits, each task keeps
    its best rows of a grouping before they meet.
    """
    failed = F.col("status") != "success" if failed is None else failed
    rows = calls.select(
        F.col(model).alias("model"),
        F.col(user).alias("user_id"),
        "prompt_tokens",
        "completion_tokens",
        "total_tokens",
        "cost_usd",
        failed.alias("failed"),
    )
    keys = [F.col("model"), F.col("user_id")]
    sums = ["prompt_tokens", "completion_tokens", "total_tokens", "calls", "failed_calls"]
    cells = rows.groupBy(*keys).agg(
        *(F.sum(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens", "cost_usd")), F.count(F.lit(1)).alias("calls"), F.count_if("failed").alias("failed_calls")
    )
    measures = [*(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in sums[:3]), F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("cost_usd"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums[3:])]
    grouped = cells.groupingSets([[keys[0]], [keys[1]], keys], *keys).agg(F.grouping_id().cast("int").alias("gid"), *measures)
    kinds = dict(rows.dtypes)
    total = cells.agg(*measures).select(*(F.lit(None).cast(kinds[c]).alias(c) for c in ("model", "user_id")), F.lit(3).alias("gid"), "*")
    grouped = grouped.unionByName(total)
    order = Window.partitionBy("gid").orderBy(F.desc("total_tokens"), F.asc_nulls_first("user_id"), F.asc_nulls_first("model"))
    named = grouped.withColumn(
        "grouping", F.when(F.col("gid") == 3, "total").when(F.col("gid") == 1, "model").when(F.col("gid") == 2, "user").otherwise("user_model")
    )
    ranked = named.withColumn("rank", F.row_number().over(order))
    if limits:
        limit = F.coalesce(*[F.when(F.col("grouping") == g, F.lit(n)) for g, n in limits.items()], F.lit(2**31 - 1))
        ranked = ranked.filter(F.col("rank") <= limit)
        if {"model", "user", "user_model"} <= limits.keys():  # a constant bound, which the planner can apply in each task
            ranked = ranked.filter(F.col("rank") <= max(limits.values()))
    return ranked.drop("gid")


def usage_cards(report: DataFrame) -> DataFrame:
    """How many user and model buckets a usage report has; the null user counts."""
    return report.agg(F.count_if(F.col("grouping") == "user").alias("users"), F.count_if(F.col("grouping") == "model").alias("models"))


def priced(calls: DataFrame, pool: DataFrame, fallback: DataFrame) -> DataFrame:
    """Adds input_per_million and output_per_million to calls by model: the pool's first entry of the model (sort_order, then
    id) unless neither price is positive, else the fallback's, else null. fallback: model, input_per_million, output_per_million."""
    first = Window.partitionBy("model").orderBy("sort_order", "id")
    best = pool.withColumn("r", F.row_number().over(first)).filter("r = 1 AND (input_per_million > 0 OR output_per_million > 0)")
    best = best.select("model", F.col("input_per_million").alias("i1"), F.col("output_per_million").alias("o1"))
    other = fallback.select("model", F.col("input_per_million").alias("i2"), F.col("output_per_million").alias("o2"))
    rows = calls.join(best, "model", "left").join(other, "model", "left")
    return rows.withColumn("input_per_million", F.coalesce("i1", "i2")).withColumn("output_per_million", F.coalesce("o1", "o2")).drop("i1", "o1", "i2", "o2")


def with_cost(calls: DataFrame, places: int = 6) -> DataFrame:
    """cost = prompt / 1e6 * input + completion / 1e6 * output, rounded; without a price 0."""
    cost = F.col("prompt_tokens") / 1e6 * F.col("input_per_million") + F.col("completion_tokens") / 1e6 * F.col("output_per_million")
    return calls.withColumn("cost", F.round(F.coalesce(cost, F.lit(0.0)), places))


def priced_twice(calls: DataFrame, pool: DataFrame, fallback: DataFrame) -> DataFrame:
    """Prices by the model that the answer names, else by the one asked for (model, requested_model)."""
    first = priced(calls, pool, fallback)
    missing = first.filter("input_per_million IS NULL").drop("input_per_million", "output_per_million")
    again = priced(missing.withColumnRenamed("model", "answered").withColumnRenamed("requested_model", "model"), pool, fallback)
    again = again.withColumnRenamed("model", "requested_model").withColumnRenamed("answered", "model")
    return first.filter("input_per_million IS NOT NULL").unionByName(again.select(*first.columns))
