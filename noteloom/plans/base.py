"""Registration of queries, each with the SQL that checks it, and the SQL of the derived views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The derived views in DuckDB's dialect; `noteloom.sources.views` builds the same in Spark.
VIEWS = {
    "notes": """notes AS (
  SELECT doc_id AS id, substr(text, 1, 60) AS title, text AS content, [source, lang] AS tags, source AS project,
         CASE doc_id % 5 WHEN 0 THEN 'note' WHEN 1 THEN 'research' WHEN 2 THEN 'decision' WHEN 3 THEN 'state' ELSE 'session' END AS doc_type,
         CASE WHEN doc_id % 10 < 6 THEN 'inferred' WHEN doc_id % 10 < 9 THEN 'observed' ELSE 'verified' END AS tier,
         TIMESTAMP '2024-01-01' + to_hours(doc_id) AS created_at,
         CASE WHEN doc_id % 17 = 0 THEN TIMESTAMP '2024-01-01' + to_hours(doc_id + 24) END AS superseded_at
  FROM documents)""",
    "retrievals": """retrievals AS (
  SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS doc_id,
         CASE event_type WHEN 'view' THEN 'hint' WHEN 'click' THEN 'kb_read' WHEN 'purchase' THEN 'kb_search' WHEN 'signup' THEN 'briefing' ELSE 'kb_context' END AS surface,
         CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'u' || user_id END AS session, ts AS created_at,
         CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'e' || (event_id // 2) END AS event_id, user_id % 29 = 0 AS is_test,
         CASE WHEN event_id % 13 = 0 THEN '<task-notification>' ELSE '' END || 'q' || (event_id % 50) AS query
  FROM events)""",
    "tool_calls": """tool_calls AS (
  SELECT event_id AS id, event_type AS tool, event_type <> 'error' AS ok, CAST(floor(value) AS BIGINT) AS duration_ms, CAST(event_id * 7 % 400 AS BIGINT) AS result_chars, ts AS created_at FROM events)""",
    "facts": """facts AS (
  SELECT o_orderkey AS id, 'customer_' || o_custkey AS subject, 'status' AS predicate, o_orderstatus AS object, CAST(o_orderdate AS DATE) AS valid_from,
         CAST(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DATE) AS valid_to FROM orders)""",
    "messages": """messages AS (
  SELECT conv_id * 1000 + turn AS id, 'c' || (conv_id % 20) AS channel, role AS sender, text AS body, CASE WHEN turn % 3 = 0 THEN 'assistant' END AS recipient, conv_id, turn FROM conversations)""",
    "vectors": "vectors AS (SELECT vec_id AS id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v, label FROM embeddings)",
}


def with_views(*names: str) -> str:
    return "WITH " + ",\n".join(VIEWS[n] for n in names) + "\n"


def query(sql: str | None = None, views: tuple[str, ...] = ()) -> Callable:
    """Register a query under its function's name; `sql` may follow the named views, or go on with further ones after a comma."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            text = sql.strip()
            if views:
                text = with_views(*views).rstrip() + ("" if text.startswith(",") else "\n") + text
            SQL[f.__name__] = text
        return f

    return register
