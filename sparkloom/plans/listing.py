"""Listings, predicates and message pages."""

from pyspark.sql import functions as F

from sparkloom.operators import listing as L
from sparkloom.operators.usage import priced, with_cost
from sparkloom.plans.views import ctes, view

DAY = "CAST('2024-01-15 00:00:00' AS TIMESTAMP)"
#: name: (view, filters, limit, offset, WHERE)
PAGES = {
    "f01_list_sessions": ("sessions", {"status": "active", "user_id": 3}, 20, 5, "status = 'active' AND user_id = 3"),
    "f02_list_task_runs": ("task_runs", {"status": "completed", "session_id": 7}, None, 0, "status = 'completed' AND session_id = 7"),
    "f03_task_runs_of_session": ("task_runs", {"session_id": 11}, 50, 0, "session_id = 11"),
    "f04_list_agent_runs": ("agent_runs", {"agent_id": "agent-2", "status": "failed"}, None, 10, "agent_id = 'agent-2' AND status = 'failed'"),
    "f06_list_tool_calls": (
        "tool_calls", {"error_category": "policy_denied", "retryable": False, "tool_name": "http_request"}, None, 0,
        "json_extract_string(metrics, '$.error_category') = 'policy_denied' AND NOT coalesce(json_extract_string(metrics, '$.retryable') = 'true', false) AND tool_name = 'http_request'",
    ),
    "f07_list_llm_calls": ("calls", {"agent_id": "agent-1", "status": "failed"}, None, 0, "agent_id = 'agent-1' AND status = 'failed'"),
    "f09_list_workflow_runs": ("workflow_runs", {"user_id": "12", "status": "completed"}, None, 0, "json_extract_string(metadata_payload, '$.user_id') = '12' AND status = 'completed'"),
    "f10_recent_workflow_runs": ("workflow_runs", {}, 20, 0, "true"),
    "f11_list_submissions": ("submissions", {"status": "success"}, None, 3, "status = 'success'"),
    "f12_list_reviews": ("reviews", {"status": "", "user_id": 9}, None, 0, "user_id = 9"),
    "f13_list_memories": ("memories", {"scope": "user", "scope_key": "5"}, None, 0, "scope = 'user' AND scope_key = '5'"),
    "f14_list_models": ("model_pool", {"enabled": True}, None, 0, "enabled"),
    "f15_list_users": ("users", {}, None, 0, "true"),
}


def _order(keys) -> str:
    return ", ".join(f"{k[1:]} DESC" if k.startswith("-") else k for k in keys)


QUERIES, ORACLES = {}, {}
for _name, (_view, _filters, _limit, _offset, _where) in PAGES.items():
    _spec = L.LISTINGS[_view]
    QUERIES[_name] = lambda s, d, v=_view, f=_filters, n=_limit, o=_offset: L.LISTINGS[v].page(view(s, d, v), n, o, **f)
    _n = _spec.limit if _limit is None else _limit
    ORACLES[_name] = f"WITH {ctes(_view)} SELECT * FROM {_view} WHERE {_where} ORDER BY {_order(_spec.order)} LIMIT {_n} OFFSET {_offset}"
    QUERIES[_name + "_total"] = lambda s, d, v=_view, f=_filters: L.LISTINGS[v].total(view(s, d, v), **f)
    ORACLES[_name + "_total"] = f"WITH {ctes(_view)} SELECT count(*) AS total FROM {_view} WHERE {_where}"

QUERIES |= {
    "f05_agent_runs_of_request": lambda s, d: view(s, d, "agent_runs").filter("request_id = 33").orderBy("step_index"),
    "f16_point_lookup": lambda s, d: view(s, d, "task_runs").filter(F.col("request_id") == 64),
    "f17_overdue_reviews": lambda s, d: L.overdue(view(s, d, "reviews"), F.lit("1995-03-05 00:00:00").cast("timestamp_ntz"), newest=None, within_hours=24 * 30),
    "f18_row_scope": lambda s, d: L.scoped(view(s, d, "sessions"), "4", False),
    "f19_console_filters": lambda s, d: view(s, d, "tool_calls").filter((F.col("status") != "success") & L.json_true("metrics", "$.retryable")).select("id", "status"),
    "f20_workflow_status": lambda s, d: view(s, d, "submissions").select("task_id", L.workflow_status().alias("workflow_status")),
    "f21_terminal_reason": lambda s, d: view(s, d, "submissions").select("task_id", L.terminal_reason().alias("terminal_reason"), L.review_id().alias("review_id")),
    "f22_tool_call_response": lambda s, d: L.tool_call_response(view(s, d, "tool_calls")),
    "f23_documents_matching": lambda s, d: s.read.parquet(f"{d}/documents.parquet").filter(F.lower("text").contains("elle") | F.lower("source").contains("src1")).select("doc_id"),
    "t02_newest_messages": lambda s, d: L.newest(view(s, d, "messages"), 2).select("session_id", "step_index", "role", "position"),
    "t03_message_page": lambda s, d: L.message_page(view(s, d, "messages").filter("session_id = 3"), 2, 1).select("session_id", "step_index"),
    "t03_message_page_legacy": lambda s, d: L.message_page(view(s, d, "messages").filter("session_id = 3"), 2, 1, legacy=True).select("session_id", "step_index"),
    "t04_recall": lambda s, d: L.recall(view(s, d, "memories"), 4, {"user": "3", "project": "7"}).select("id", "scope", "rank", "scope_rank", "importance"),
    "t05_default_entry": lambda s, d: L.first_entry(view(s, d, "model_pool")),
    "t09_transcript": lambda s, d: L.transcript(view(s, d, "messages"), 4, 60),
    "k03_one_default": lambda s, d: L.one_default(view(s, d, "model_pool")).filter("is_default").select("id", "name"),
    "j03_priced_calls": lambda s, d: priced(_named(view(s, d, "calls")), view(s, d, "model_pool"), _fallback(s)).select("id", "model", "input_per_million", "output_per_million"),
    "x12_call_cost": lambda s, d: with_cost(priced(_named(view(s, d, "calls")), view(s, d, "model_pool"), _fallback(s)), 10).select("id", "cost"),
}
TYPES = ("STANDARD ANODIZED TIN", "SMALL PLATED COPPER")


def _named(calls):
    """Calls with the pool's model names: three of the pool's types, one of the fallback's, one of neither."""
    name = F.when(F.col("model") == "click", F.lit("ECONOMY")).when(F.col("model") == "view", "PROMO").when(F.col("model") == "error", "house").otherwise("none")
    return calls.withColumn("model", name)


def _fallback(spark):
    return spark.createDataFrame([("house", 1.5, 3.0), ("PROMO", 0.25, 0.5)], "model string, input_per_million double, output_per_million double")


PRICED = f"""WITH {ctes('calls', 'model_pool')},
c AS (SELECT id, prompt_tokens, completion_tokens, CASE model WHEN 'click' THEN 'ECONOMY' WHEN 'view' THEN 'PROMO' WHEN 'error' THEN 'house' ELSE 'none' END AS model FROM calls),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY sort_order, id) AS r FROM model_pool) WHERE r = 1 AND (input_per_million > 0 OR output_per_million > 0)),
f AS (SELECT * FROM (VALUES ('house', 1.5::DOUBLE, 3.0::DOUBLE), ('PROMO', 0.25::DOUBLE, 0.5::DOUBLE)) t(model, i, o)),
x AS (SELECT c.*, coalesce(p.input_per_million, f.i) AS input_per_million, coalesce(p.output_per_million, f.o) AS output_per_million FROM c LEFT JOIN p USING (model) LEFT JOIN f USING (model))"""
ORACLES |= {
    "f05_agent_runs_of_request": f"WITH {ctes('agent_runs')} SELECT * FROM agent_runs WHERE request_id = 33",
    "f16_point_lookup": f"WITH {ctes('task_runs')} SELECT * FROM task_runs WHERE request_id = 64",
    "f17_overdue_reviews": f"""WITH {ctes('reviews')} SELECT * FROM reviews WHERE status = 'pending' AND created_at > TIMESTAMP '1995-03-05' - INTERVAL 720 HOURS
      AND created_at <= TIMESTAMP '1995-03-05' - INTERVAL 30 MINUTES""",
    "f18_row_scope": f"WITH {ctes('sessions')} SELECT * FROM sessions WHERE user_id = 4",
    "f19_console_filters": f"WITH {ctes('tool_calls')} SELECT id, status FROM tool_calls WHERE status <> 'success' AND json_extract_string(metrics, '$.retryable') = 'true'",
    "f20_workflow_status": f"""WITH {ctes('submissions')} SELECT task_id, CASE WHEN status = 'pending' THEN 'pending' WHEN status IN ('received', 'started', 'retry') THEN 'running' WHEN status = 'failure' THEN 'failed'
      WHEN status = 'success' THEN CASE WHEN json_extract_string(result_payload, '$.status') IN ('pending', 'running', 'completed', 'failed', 'needs_human_review', 'cancelled')
      THEN json_extract_string(result_payload, '$.status') ELSE 'completed' END END AS workflow_status FROM submissions""",
    "f21_terminal_reason": f"""WITH {ctes('submissions')} SELECT task_id, CASE WHEN json_extract_string(result_payload, '$.terminal_reason') IN ('completed', 'failed', 'human_review', 'max_steps', 'cancelled')
      THEN json_extract_string(result_payload, '$.terminal_reason') END AS terminal_reason, nullif(json_extract_string(result_payload, '$.review_id'), '') AS review_id FROM submissions""",
    "f22_tool_call_response": f"""WITH {ctes('tool_calls')} SELECT id, request_id, tool_name, status, json_extract_string(metrics, '$.error_category') AS error_category,
      coalesce(json_extract_string(metrics, '$.retryable') = 'true', false) AS retryable, CAST(json_extract_string(metrics, '$.latency_ms') AS BIGINT) AS latency_ms FROM tool_calls""",
    "f23_documents_matching": "SELECT doc_id FROM documents WHERE contains(lower(text), 'elle') OR contains(lower(source), 'src1')",
    "t02_newest_messages": f"""WITH {ctes('messages')} SELECT session_id, step_index, role, CAST(row_number() OVER (PARTITION BY session_id ORDER BY step_index, id) AS INTEGER) AS position
      FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY step_index DESC, id DESC) AS b FROM messages) WHERE b <= 2""",
    "t03_message_page": f"WITH {ctes('messages')} SELECT session_id, step_index FROM messages WHERE session_id = 3 ORDER BY step_index, id LIMIT 2 OFFSET 1",
    "t03_message_page_legacy": f"""WITH {ctes('messages')} SELECT session_id, step_index FROM (SELECT * FROM messages WHERE session_id = 3 ORDER BY step_index DESC, id DESC LIMIT 3) ORDER BY step_index, id OFFSET 1""",
    "t04_recall": f"""WITH {ctes('memories')} SELECT id, scope, rank, CASE scope WHEN 'user' THEN 0 WHEN 'project' THEN 1 ELSE 2 END AS scope_rank, importance FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY scope ORDER BY importance DESC, created_at DESC, id) AS INTEGER) AS rank FROM memories
      WHERE scope = 'global' OR (scope = 'user' AND scope_key = '3') OR (scope = 'project' AND scope_key = '7')) WHERE rank <= 4""",
    "t05_default_entry": f"WITH {ctes('model_pool')} SELECT * FROM model_pool WHERE enabled AND is_default ORDER BY sort_order, name LIMIT 1",
    "t09_transcript": f"""WITH {ctes('messages')} SELECT session_id, string_agg(role || ': ' || substring(content, 1, 60), chr(10) ORDER BY step_index, id) AS transcript
      FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY step_index DESC, id DESC) AS b FROM messages) WHERE b <= 4 AND role IN ('user', 'assistant') GROUP BY session_id""",
    "k03_one_default": f"WITH {ctes('model_pool')} SELECT id, name FROM model_pool WHERE is_default ORDER BY id DESC LIMIT 1",
    "j03_priced_calls": f"{PRICED} SELECT id, model, input_per_million, output_per_million FROM x",
    "x12_call_cost": f"{PRICED} SELECT id, round(coalesce(prompt_tokens / 1e6 * input_per_million + completion_tokens / 1e6 * output_per_million, 0), 10) AS cost FROM x",
}
