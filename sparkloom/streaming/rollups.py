"""Structured Streaming: windowed usage, deduplicated requests, the latest heartbeat of each worker, joined message deltas.

Windowed usage, watermarks and late data are this engine's own; the others do what the batch operators do, on streams.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of event files as a stream, with event time as a timestamp."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_usage(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Calls and value by window and type; rows later than the watermark are dropped."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    rows = events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("calls"), F.sum("value").alias("value"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "calls", "value")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    window = F.session_window("ts", gap)
    rows = events.withWatermark("ts", late).groupBy(window.alias("w"), "user_id").agg(F.count(F.lit(1)).alias("calls"))
    return rows.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "calls")


def new_requests(events: DataFrame, key: str = "event_id", late: str = "2 hours") -> DataFrame:
    """The first row of each request within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def answered(requests: DataFrame, answers: DataFrame, within: str = "10 minutes", late: str = "2 hours") -> DataFrame:
    """request_id, ts, answered_at: requests (request_id, ts) with their answers (request_id, answered_at) that come within the time. Two
    streams: watermarks and the time range bound what either side keeps."""
    left = requests.select("request_id", "ts").withWatermark("ts", late)
    right = answers.select(F.col("request_id").alias("_of"), "answered_at").withWatermark("answered_at", late)
    rows = left.join(right, F.expr(f"request_id = _of AND answered_at >= ts AND answered_at <= ts + INTERVAL {within}"))
    return rows.select("request_id", "ts", "answered_at")


def latest_beats(beats: DataFrame, time_to_live_ms: int) -> DataFrame:
    """worker_id, beat_at, live: the newest beat of each worker (worker_id, beat_at); a worker silent for the time to live is
    reported once as not live and forgotten. State is one timestamp a worker."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"worker_id": [key[0]], "beat_at": [pd.Timestamp(last, unit="us")], "live": [False]})
            return
        last = state.get[0] if state.exists else 0
        for pdf in batches:
            last = max(last, int(pdf["beat_at"].astype("datetime64[us]").max().value // 1000))
        state.update((last,))
        state.setTimeoutDuration(time_to_live_ms)
        yield pd.DataFrame({"worker_id": [key[0]], "beat_at": [pd.Timestamp(last, unit="us")], "live": [True]})

    out = "worker_id long, beat_at timestamp, live boolean"
    return beats.groupBy("worker_id").applyInPandasWithState(update, out, "last long", "update", "ProcessingTimeTimeout")


def joined_deltas(deltas: DataFrame) -> DataFrame:
    """request_id, text, tokens, finish_reason of streamed pieces (request_id, seq, delta, usage, finish_reason): pieces in order, the
    last usage and reason that are set."""
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("seq", c)))[c]
    pieces = F.array_sort(F.collect_list(F.struct("seq", F.coalesce("delta", F.lit("")).alias("delta"))))
    return deltas.groupBy("request_id").agg(F.array_join(F.transform(pieces, lambda x: x["delta"]), "").alias("text"), last("usage").alias("tokens"), last("finish_reason").alias("finish_reason"))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Write what is there and stop: a scheduled run."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
