"""Usage reports: an event stands for a call, its type for the model."""

from pyspark.sql import functions as F

from sparkloom.operators.usage import usage_cards, usage_report
from sparkloom.plans.views import ctes, view

LIMITS = {"model": 100, "user": 200, "user_model": 500}
REPORT = f"""WITH {ctes('calls')}, g AS (
  SELECT model, user_id, grouping(model) * 2 + grouping(user_id) AS gid, CAST(coalesce(sum(prompt_tokens), 0) AS BIGINT) AS prompt_tokens,
         CAST(coalesce(sum(completion_tokens), 0) AS BIGINT) AS completion_tokens, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS total_tokens,
         round(coalesce(sum(cost_usd), 0), 6) AS cost_usd, count(*) AS calls, count(*) FILTER (WHERE status <> 'success') AS failed_calls
  FROM calls GROUP BY GROUPING SETS ((), (model), (user_id), (model, user_id))),
report AS (SELECT * EXCLUDE (gid) FROM (
  SELECT *, CASE gid WHEN 3 THEN 'total' WHEN 1 THEN 'model' WHEN 2 THEN 'user' ELSE 'user_model' END AS "grouping",
         CAST(row_number() OVER (PARTITION BY gid ORDER BY total_tokens DESC, user_id NULLS FIRST, model NULLS FIRST) AS INTEGER) AS rank FROM g)
WHERE rank <= CASE "grouping" WHEN 'model' THEN 100 WHEN 'user' THEN 200 WHEN 'user_model' THEN 500 ELSE 1 END)"""

QUERIES = {
    "a01_usage_report": lambda s, d: usage_report(view(s, d, "calls"), limits=LIMITS),
    "a31_usage_cards": lambda s, d: usage_cards(usage_report(view(s, d, "calls"), limits=LIMITS)),
    "f08_usage_window": lambda s, d: view(s, d, "calls").filter(
        (F.col("model") == "click") & F.col("created_at").between(F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-10").cast("timestamp_ntz"))
    ),
}
ORACLES = {
    "a01_usage_report": f"{REPORT} SELECT * FROM report",
    "a31_usage_cards": f"""{REPORT} SELECT count(*) FILTER (WHERE "grouping" = 'user') AS users, count(*) FILTER (WHERE "grouping" = 'model') AS models FROM report""",
    "f08_usage_window": f"WITH {ctes('calls')} SELECT * FROM calls WHERE model = 'click' AND created_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-10'",
}
