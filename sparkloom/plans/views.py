"""The audit tables as views of the driver's tables: in Spark, and as common table expressions for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.tables import table

SQL = {
    "calls": """SELECT event_id AS id, event_id % 997 AS request_id, event_id % 101 AS session_id, CASE WHEN user_id % 50 <> 0 THEN user_id END AS user_id,
  concat('agent-', CAST(event_id % 5 AS {S})) AS agent_id, event_type AS model, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
  k AS prompt_tokens, k % 7 AS completion_tokens, k + k % 7 AS total_tokens, (event_id * 37) % 1000 AS latency_ms, CAST(0.5 AS DOUBLE) AS cost_usd, ts AS created_at
  FROM (SELECT *, coalesce(CAST({J}(props, '$.k') AS INTEGER), 0) AS k FROM events) e""",
    "tool_calls": """SELECT event_id AS id, event_id % 997 AS request_id, concat('agent-', CAST(event_id % 5 AS {S})) AS agent_id,
  CASE event_id % 3 WHEN 0 THEN 'knowledge_search' WHEN 1 THEN 'http_request' ELSE 'document_parser' END AS tool_name,
  CASE WHEN event_id % 7 = 0 THEN 'denied' WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
  CASE WHEN event_id % 7 = 0 THEN '{{"error_category":"policy_denied","retryable":false}}' WHEN event_type = 'error' THEN '{{"error_category":"timeout","retryable":true,"latency_ms":12}}'
       WHEN event_id % 11 = 0 THEN '{{"error_category":""}}' ELSE '{{}}' END AS metrics,
  CASE WHEN event_id % 3 = 0 THEN concat('{{"query":"q","hits":', CAST(event_id % 4 AS {S}), ',"backend":"', CASE WHEN event_id % 2 = 0 THEN 'bm25' ELSE 'vector' END, '","results":[',
       CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '1' WHEN 2 THEN '1,2' ELSE '1,2,3' END, ']}}') ELSE '{{}}' END AS content, ts AS created_at FROM events""",
    "task_runs": """SELECT o_orderkey AS id, o_orderkey AS request_id, o_custkey % 50 AS session_id, o_orderpriority AS workflow_id,
  CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'completed' ELSE 'running' END AS status, o_orderdate AS created_at FROM orders""",
    "agent_runs": """SELECT l_orderkey AS request_id, l_linenumber AS step_index, concat('agent-', CAST(l_suppkey % 5 AS {S})) AS agent_id, l_orderkey * 100 + l_linenumber * 10 + l_suppkey % 10 AS id,
  l_partkey AS part_id, CASE l_linestatus WHEN 'F' THEN 'failed' ELSE 'completed' END AS status, l_shipdate AS created_at FROM lineitem""",
    "workflow_runs": """SELECT o_orderkey AS id, o_orderkey AS request_id, CASE o_orderstatus WHEN 'F' THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN o_custkey % 5 = 0 THEN '{{}}' ELSE concat('{{"user_id":"', CAST(o_custkey % 40 AS {S}), '"}}') END AS metadata_payload, o_orderdate AS created_at FROM orders""",
    "submissions": """SELECT o_orderkey AS task_id, o_orderkey AS request_id, o_custkey % 50 AS session_id, o_custkey AS user_id,
  CASE o_orderkey % 7 WHEN 0 THEN 'pending' WHEN 1 THEN 'received' WHEN 2 THEN 'started' WHEN 3 THEN 'retry' WHEN 4 THEN 'failure' WHEN 5 THEN 'success' ELSE 'revoked' END AS status,
  CASE o_custkey % 4 WHEN 0 THEN '{{"status":"needs_human_review","terminal_reason":"human_review","review_id":"r1"}}' WHEN 1 THEN '{{"status":"odd","terminal_reason":"odd","review_id":""}}'
       WHEN 2 THEN '{{"status":"failed","terminal_reason":"max_steps"}}' ELSE NULL END AS result_payload, o_orderdate AS created_at FROM orders""",
    "reviews": """SELECT o_orderkey AS id, o_orderkey AS request_id, o_custkey % 40 AS user_id, CASE o_orderkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' ELSE 'rejected' END AS status,
  CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey - 5 END AS source_review_id, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey + 1 END AS continuation_request_id, o_orderdate AS created_at FROM orders""",
    "sessions": """SELECT c_custkey AS id, c_custkey AS session_id, c_nationkey AS user_id, CASE WHEN c_acctbal < 0 THEN 'closed' ELSE 'active' END AS status, c_acctbal AS created_at FROM customer""",
    "messages": """SELECT conv_id * 1000 + turn AS id, conv_id AS session_id, turn AS step_index, role, text AS content FROM conversations""",
    "memories": """SELECT c_custkey AS id, c_mktsegment AS memory_type, CASE c_custkey % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'project' ELSE 'global' END AS scope,
  CASE c_custkey % 3 WHEN 2 THEN '' ELSE CAST(c_nationkey AS {S}) END AS scope_key, c_name AS content, CASE WHEN c_custkey % 2 = 0 THEN 'llm' ELSE 'manual' END AS source,
  CAST(c_custkey % 5 + 1 AS INTEGER) AS importance, c_acctbal AS created_at FROM customer""",
    "model_pool": """SELECT p_partkey AS id, concat(p_name, '-', CAST(p_partkey AS {S})) AS name, p_type AS model, p_size AS sort_order, p_partkey % 2 = 0 AS enabled,
  CASE WHEN p_partkey % 5 = 0 THEN 0.0 ELSE p_retailprice END AS input_per_million, CASE WHEN p_partkey % 5 = 0 THEN 0.0 ELSE p_retailprice * 2 END AS output_per_million,
  p_partkey % 97 = 0 AS is_default FROM part""",
    "users": """SELECT c_custkey AS id, c_name AS username, CASE WHEN c_custkey % 10 = 0 THEN 'admin' ELSE 'member' END AS role, c_acctbal AS created_at FROM customer""",
}
BASE = {
    "calls": "events", "tool_calls": "events", "task_runs": "orders", "agent_runs": "lineitem", "workflow_runs": "orders", "submissions": "orders", "reviews": "orders",
    "sessions": "customer", "messages": "conversations", "memories": "customer", "model_pool": "part", "users": "customer",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base = table(spark, sf_dir, BASE[name])
    text = SQL[name].format(S="STRING", J="get_json_object").replace(f"FROM {BASE[name]}", "FROM {base}")
    return spark.sql(_escaped(text), base=base)


def _escaped(text: str) -> str:
    """spark.sql formats its text once more: braces of JSON texts are doubled, the table's placeholder is not."""
    return text.replace("{base}", "\0").replace("{", "{{").replace("}", "}}").replace("\0", "{base}")


def ctes(*names: str) -> str:
    return ", ".join(f"{n} AS ({SQL[n].format(S='VARCHAR', J='json_extract_string')})" for n in names)
