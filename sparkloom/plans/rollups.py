"""Run details, dashboards, recent windows, set operations and joins of the audit tables."""

from pyspark.sql import functions as F

from sparkloom.operators import joins as J
from sparkloom.operators import rollups as R
from sparkloom.plans.views import ctes, view

DETAILS = f"""WITH {ctes('task_runs', 'agent_runs', 'tool_calls', 'calls')},
a AS (SELECT request_id, count(*) AS n FROM agent_runs GROUP BY 1), t AS (SELECT request_id, count(*) AS n FROM tool_calls GROUP BY 1),
c AS (SELECT request_id, count(*) AS n, sum(CASE WHEN status = 'success' THEN total_tokens ELSE 0 END) AS tokens, sum(cost_usd) AS cost FROM calls GROUP BY 1),
details AS (SELECT r.request_id, r.session_id, r.created_at, r.status, CAST(coalesce(a.n, 0) AS BIGINT) AS agent_runs, CAST(coalesce(t.n, 0) AS BIGINT) AS tool_calls,
  CAST(coalesce(c.n, 0) AS BIGINT) AS llm_calls, CAST(coalesce(c.tokens, 0) AS BIGINT) AS tokens, round(coalesce(c.cost, 0), 6) AS cost
  FROM task_runs r LEFT JOIN a USING (request_id) LEFT JOIN t USING (request_id) LEFT JOIN c USING (request_id))"""
SESSION = "SELECT session_id, count(*) AS task_runs, CAST(sum(agent_runs) AS BIGINT) AS agent_runs, CAST(sum(tool_calls) AS BIGINT) AS tool_calls, CAST(sum(llm_calls) AS BIGINT) AS llm_calls, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost), 6) AS cost"
DASH = ("task_runs", "tool_calls", "workflow_runs", "reviews", "memories", "calls", "messages")


def details(s, d):
    return R.run_details(*(view(s, d, v) for v in ("task_runs", "agent_runs", "tool_calls", "calls")))


QUERIES = {
    "a02_run_details": details,
    "a03_workflow_run_details": lambda s, d: details(s, d).select("request_id", "agent_runs", "llm_calls", "tokens", "cost", F.lit(1).alias("task_run_count")),
    "a04_session_details": lambda s, d: R.session_details(details(s, d)),
    "a04_session_details_newest_50": lambda s, d: R.session_details(details(s, d), 50),
    "a05_table_count": lambda s, d: view(s, d, "tool_calls").filter("status = 'failed'").agg(F.count(F.lit(1)).alias("n")),
    "a06_group_counts": lambda s, d: R.counts_by(view(s, d, "calls"), "user_id", "calls_by_user"),
    "a07_dashboard": lambda s, d: R.dashboard({v: view(s, d, v) for v in DASH}),
    "a08_recent_tool_stats": lambda s, d: R.recent_tool_stats(view(s, d, "tool_calls")),
    "a09_message_counts": lambda s, d: view(s, d, "messages").groupBy("session_id").agg(F.count(F.lit(1)).alias("n")),
    "a30_retrieved_summary": lambda s, d: R.retrieved_summary(view(s, d, "tool_calls")),
    "j02_session_children": lambda s, d: J.session_children(view(s, d, "task_runs"), view(s, d, "agent_runs")),
    "j11_known_requests": lambda s, d: J.known(view(s, d, "calls").select("request_id").distinct(), view(s, d, "task_runs"), "request_id"),
    "j12_review_chain": lambda s, d: J.review_chain(view(s, d, "reviews")),
    "j14_owner": lambda s, d: J.owner(view(s, d, "submissions"), view(s, d, "workflow_runs")),
    "k02_session_upsert": lambda s, d: J.last_wins(view(s, d, "task_runs"), "session_id", ("created_at", "request_id")).select("session_id", "request_id", "status"),
    "k04_invalid_decisions": lambda s, d: J.invalid_transitions(_decisions(view(s, d, "reviews"))),
    "k05_circuit_breaker": lambda s, d: J.breaker(view(s, d, "calls").select(F.col("agent_id").alias("key"), "id", F.col("status").alias("outcome"))),
    "k06_new_requests": lambda s, d: view(s, d, "task_runs").select("request_id").join(view(s, d, "calls").select("request_id"), "request_id", "left_anti"),
    "k07_step_limit": lambda s, d: J.over_step_limit(view(s, d, "agent_runs"), 5),
    "k08_refresh_pending": lambda s, d: J.refreshed(view(s, d, "submissions"), view(s, d, "task_runs").withColumnRenamed("status", "new_status")),
    "k09_session_delete": lambda s, d: view(s, d, "messages").join(view(s, d, "sessions").filter("status = 'closed'").select("session_id"), "session_id", "left_anti").select("id", "session_id"),
    "k09_memory_patch": lambda s, d: J.patched(view(s, d, "memories"), view(s, d, "memories").filter("id % 3 = 0").select("id", F.lit("new").alias("content"), F.lit(None).cast("int").alias("importance")), "id", ("content", "importance")).select("id", "content", "importance"),
    "q02_distinct_in_order": lambda s, d: J.distinct_in_order(view(s, d, "agent_runs"), "request_id", "agent_id", ("step_index", "id", "part_id")),
    "q05_last_row_wins": lambda s, d: J.last_wins(view(s, d, "tool_calls"), "request_id", ("id",)).select("request_id", "id", "status"),
    "x16_heartbeats": lambda s, d: R.heartbeats(_beats(s, d), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), 86400.0).select("worker_id", F.round("age", 0).cast("bigint").alias("age"), "stale"),
    "x17_stalled": lambda s, d: _queues(s, d).select("queue", R.stalled(*(F.col(c) for c in ("reachable", "ready", "unacked", "age", "visibility"))).alias("stalled")),
    "x18_worker_status": lambda s, d: _queues(s, d).select("queue", R.worker_status(F.col("reachable"), F.col("live"), F.col("stale"), R.stalled(*(F.col(c) for c in ("reachable", "ready", "unacked", "age", "visibility")))).alias("status")),
    "a28_queue_summary": lambda s, d: R.queue_summary(_queues(s, d).withColumnRenamed("age", "oldest_unacked_age_seconds")),
    "j15_worker_inventory": lambda s, d: R.worker_inventory(
        _part(s, d, "p_partkey % 2 = 0").select("worker", F.lit(True).alias("alive")), _part(s, d, "p_partkey % 3 = 0").select("worker", F.col("p_size").alias("pool_size")), _part(s, d, "p_partkey % 5 = 0").select("worker", F.col("p_brand").alias("queue"))
    ),
}


def _part(s, d, where):
    return s.read.parquet(f"{d}/part.parquet").filter(where).withColumn("worker", F.col("p_partkey"))


def _beats(s, d):
    return s.read.parquet(f"{d}/events.parquet").select(F.when(F.col("event_id") % 50 != 0, F.col("user_id")).alias("worker_id"), F.col("ts").alias("beat_at"))


def _queues(s, d):
    k = F.col("p_partkey")
    return s.read.parquet(f"{d}/part.parquet").select(
        k.alias("queue"), (k % 7 != 0).alias("reachable"), (k % 3).alias("ready"), (k % 2).alias("unacked"), F.when(k % 5 != 0, k % 100).cast("double").alias("age"), F.lit(40.0).alias("visibility"), (k % 4).alias("live"), (k % 2).alias("stale")
    )


def _decisions(reviews):
    return reviews.select(F.col("user_id").alias("review_id"), F.col("id").alias("ord"), "status")


QUEUES = """q AS (SELECT p_partkey AS queue, p_partkey % 7 <> 0 AS reachable, p_partkey % 3 AS ready, p_partkey % 2 AS unacked, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_partkey % 100 AS DOUBLE) END AS age,
  40.0 AS visibility, p_partkey % 4 AS live, p_partkey % 2 AS stale FROM part),
st AS (SELECT *, CASE WHEN NOT reachable THEN false WHEN ready > 0 THEN true WHEN unacked = 0 THEN false WHEN age IS NULL THEN false ELSE age > visibility END AS stalled FROM q)"""
ORACLES = {
    "a02_run_details": f"{DETAILS} SELECT * FROM details",
    "a03_workflow_run_details": f"{DETAILS} SELECT request_id, agent_runs, llm_calls, tokens, cost, 1 AS task_run_count FROM details",
    "a04_session_details": f"{DETAILS} {SESSION} FROM details GROUP BY session_id",
    "a04_session_details_newest_50": f"{DETAILS} {SESSION} FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, request_id) AS r FROM details) WHERE r <= 50 GROUP BY session_id",
    "a05_table_count": f"WITH {ctes('tool_calls')} SELECT count(*) AS n FROM tool_calls WHERE status = 'failed'",
    "a06_group_counts": f"WITH {ctes('calls')} SELECT 'calls_by_user' AS measure, CAST(user_id AS VARCHAR) AS key, count(*) AS n FROM calls WHERE user_id IS NOT NULL GROUP BY user_id",
    "a07_dashboard": f"WITH {ctes(*DASH)} "
    + " UNION ALL ".join(
        [f"SELECT '{t}' AS measure, 'all' AS key, count(*) AS n FROM {t}" for t in DASH]
        + [f"SELECT '{t}_by_status', status, count(*) FROM {t} GROUP BY status" for t in ("task_runs", "tool_calls", "workflow_runs", "reviews")]
        + [f"SELECT 'memories_by_{c}', {c}, count(*) FROM memories GROUP BY {c}" for c in ("scope", "source")]
        + [f"SELECT 'with_{c}', 'all', count({c}) FROM reviews" for c in ("continuation_request_id", "source_review_id")]
    ),
    "a08_recent_tool_stats": f"""WITH {ctes('tool_calls')}, r AS (SELECT * FROM tool_calls ORDER BY created_at DESC, id LIMIT 500)
      SELECT 'error_category' AS measure, json_extract_string(metrics, '$.error_category') AS key, count(*) AS n FROM r WHERE json_extract_string(metrics, '$.error_category') <> '' GROUP BY 2
      UNION ALL SELECT 'total', 'retryable', count(*) FROM r WHERE json_extract_string(metrics, '$.retryable') = 'true'
      UNION ALL SELECT 'total', 'searches', count(*) FROM r WHERE tool_name = 'knowledge_search'
      UNION ALL SELECT 'total', 'results', CAST(coalesce(sum(json_array_length(content, '$.results')), 0) AS BIGINT) FROM r WHERE tool_name = 'knowledge_search'""",
    "a09_message_counts": f"WITH {ctes('messages')} SELECT session_id, count(*) AS n FROM messages GROUP BY 1",
    "a30_retrieved_summary": f"""WITH {ctes('tool_calls')}, x AS (SELECT request_id, id, CAST(json_extract_string(content, '$.hits') AS INTEGER) AS hits, json_extract_string(content, '$.backend') AS backend,
        CAST(json_extract(content, '$.results') AS INTEGER[]) AS results FROM tool_calls WHERE tool_name = 'knowledge_search'),
      u AS (SELECT request_id, r, min(id * 10 + i) AS pos FROM (SELECT request_id, id, unnest(results) AS r, generate_subscripts(results, 1) AS i FROM x) GROUP BY 1, 2),
      o AS (SELECT request_id, string_agg(CAST(r AS VARCHAR), ',' ORDER BY pos) AS refs FROM u GROUP BY 1)
      SELECT x.request_id, CAST(sum(hits) AS BIGINT) AS hits, coalesce(any_value(o.refs), '') AS refs, string_agg(DISTINCT backend, ',' ORDER BY backend) AS backends FROM x LEFT JOIN o USING (request_id) GROUP BY x.request_id""",
    "j02_session_children": f"""WITH {ctes('task_runs', 'agent_runs')} SELECT t.session_id, t.request_id, a.step_index, a.agent_id, a.id FROM task_runs t JOIN agent_runs a USING (request_id)""",
    "j11_known_requests": f"""WITH {ctes('calls', 'task_runs')} SELECT request_id, request_id IN (SELECT request_id FROM task_runs) AS known FROM (SELECT DISTINCT request_id FROM calls)""",
    "j12_review_chain": f"""WITH RECURSIVE {ctes('reviews')}, c AS (SELECT id, id AS root, 0 AS depth FROM reviews WHERE source_review_id IS NULL OR source_review_id NOT IN (SELECT id FROM reviews)
      UNION ALL SELECT r.id, c.root, c.depth + 1 FROM reviews r JOIN c ON r.source_review_id = c.id) SELECT id, root, depth FROM c""",
    "j14_owner": f"""WITH {ctes('submissions', 'workflow_runs')} SELECT s.request_id, coalesce(CASE WHEN s.user_id % 3 <> 0 THEN CAST(s.user_id AS VARCHAR) END, json_extract_string(w.metadata_payload, '$.user_id')) AS owner
      FROM submissions s LEFT JOIN workflow_runs w USING (request_id)""",
    "k02_session_upsert": f"WITH {ctes('task_runs')} SELECT session_id, request_id, status FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, request_id DESC) AS r FROM task_runs) WHERE r = 1",
    "k04_invalid_decisions": f"""WITH {ctes('reviews')} SELECT review_id, ord, status FROM (SELECT user_id AS review_id, id AS ord, status, lag(status) OVER (PARTITION BY user_id ORDER BY id) AS before FROM reviews)
      WHERE before IS NOT NULL AND NOT (before = 'pending' AND status IN ('approved', 'rejected'))""",
    "k05_circuit_breaker": f"""WITH {ctes('calls')}, x AS (SELECT agent_id AS key, id, status, lag(status, 1) OVER w AS s1, lag(status, 2) OVER w AS s2 FROM calls WINDOW w AS (PARTITION BY agent_id ORDER BY id))
      SELECT key, min(id) AS opened_at FROM x WHERE status = 'quota' OR (status = 'failed' AND s1 = 'failed' AND s2 = 'failed') GROUP BY key""",
    "k06_new_requests": f"WITH {ctes('task_runs', 'calls')} SELECT request_id FROM task_runs WHERE request_id NOT IN (SELECT request_id FROM calls)",
    "k07_step_limit": f"WITH {ctes('agent_runs')} SELECT request_id, count(*) AS steps FROM agent_runs GROUP BY 1 HAVING count(*) > 5",
    "k08_refresh_pending": f"""WITH {ctes('submissions', 'task_runs')} SELECT s.task_id, CASE WHEN s.status IN ('pending', 'received', 'started', 'retry') THEN coalesce(t.status, s.status) ELSE s.status END AS status
      FROM submissions s LEFT JOIN task_runs t USING (request_id)""",
    "k09_session_delete": f"WITH {ctes('messages', 'sessions')} SELECT id, session_id FROM messages WHERE session_id NOT IN (SELECT session_id FROM sessions WHERE status = 'closed')",
    "k09_memory_patch": f"WITH {ctes('memories')} SELECT id, CASE WHEN id % 3 = 0 THEN 'new' ELSE content END AS content, importance FROM memories",
    "q02_distinct_in_order": f"""WITH {ctes('agent_runs')}, f AS (SELECT request_id, agent_id, min((step_index, id, part_id)) AS pos FROM agent_runs GROUP BY 1, 2)
      SELECT request_id, string_agg(agent_id, ',' ORDER BY pos) AS agent_id FROM f GROUP BY 1""",
    "q05_last_row_wins": f"WITH {ctes('tool_calls')} SELECT request_id, max(id) AS id, arg_max(status, id) AS status FROM tool_calls GROUP BY 1",
    "x16_heartbeats": """SELECT worker_id, age, age > 86400 AS stale FROM (SELECT CASE WHEN event_id % 50 <> 0 THEN user_id END AS worker_id,
      CAST(round(greatest(0, epoch_us(TIMESTAMP '2024-01-20') - max(epoch_us(ts))) / 1e6) AS BIGINT) AS age FROM events GROUP BY 1) WHERE worker_id IS NOT NULL""",
    "x17_stalled": f"WITH {QUEUES} SELECT queue, stalled FROM st",
    "x18_worker_status": f"WITH {QUEUES} SELECT queue, CASE WHEN NOT reachable THEN 'degraded' WHEN stalled THEN 'stalled' WHEN live > 0 THEN 'ready' WHEN stale > 0 THEN 'stalled' ELSE 'offline' END AS status FROM st",
    "a28_queue_summary": f"WITH {QUEUES} SELECT CAST(sum(ready) AS BIGINT) AS ready, CAST(sum(unacked) AS BIGINT) AS unacked, max(age) AS oldest FROM q WHERE reachable",
    "j15_worker_inventory": """SELECT p_partkey AS worker, p_partkey % 2 = 0 AS alive, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS pool_size, CASE WHEN p_partkey % 5 = 0 THEN p_brand END AS queue
      FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0 OR p_partkey % 5 = 0""",
}
