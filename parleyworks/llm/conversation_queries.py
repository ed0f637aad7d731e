"""Conversations put together from message rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import Workspace
from .conversations import conversations


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(spark, f"{sf_dir}/short_conversation.parquet", Workspace(spark, "p2"))


QUERIES = {"p2_found": p2_found}

ORACLE = {
    "p2_found": """
WITH RECURSIVE raw AS (
  SELECT lower(trim(sessionId, E' \\t\\r\\n\\f\\v')) AS s, lower(trim(uuid, E' \\t\\r\\n\\f\\v')) AS u,
         nullif(lower(trim(parentUuid, E' \\t\\r\\n\\f\\v')), '') AS p, lower(trim(message.role, E' \\t\\r\\n\\f\\v')) AS r,
         trim(message.content, E' \\t\\r\\n\\f\\v') AS c
  FROM short_conversation
  WHERE type IN ('user', 'assistant') AND isSidechain IS DISTINCT FROM true AND nullif(trim(sessionId, E' \\t\\r\\n\\f\\v'), '') IS NOT NULL),
msgs AS (
  SELECT s, u, min(p) AS p, min(r) AS r, bool_or(blank) AS blank FROM (
    SELECT s, u, p, r, c IS NULL OR c = '' OR (
      CASE WHEN c LIKE '[%' AND json_valid(c) THEN
        len(list_filter(CAST(json_extract(c, '$[*]') AS JSON[]), lambda b:
          NOT (json_extract_string(b, '$.type') = 'text' AND trim(coalesce(json_extract_string(b, '$.text'), ''), E' \\t\\r\\n\\f\\v') = ''))) = 0
      ELSE false END) AS blank FROM raw) GROUP BY s, u),
kids AS (SELECT s, p, count(*) AS n FROM msgs WHERE p IS NOT NULL GROUP BY s, p),
fine AS (
  SELECT s, count(*) AS n FROM msgs GROUP BY s
  HAVING count(*) FILTER (p IS NULL) = 1 AND NOT bool_or(blank) AND count(*) FILTER (r IS NULL OR r NOT IN ('user', 'assistant')) = 0
     AND s NOT IN (SELECT s FROM kids WHERE n > 1)),
walk AS (
  SELECT m.s, m.u, m.r, 1 AS seq FROM msgs m JOIN fine f ON f.s = m.s WHERE m.p IS NULL AND m.r = 'user'
  UNION ALL
  SELECT m.s, m.u, m.r, w.seq + 1 FROM walk w JOIN msgs m ON m.s = w.s AND m.p = w.u),
sound AS (
  SELECT f.s FROM fine f JOIN (SELECT s, count(*) AS n FROM walk GROUP BY s) c ON c.s = f.s AND c.n = f.n
  WHERE f.s NOT IN (SELECT a.s FROM walk a LEFT JOIN walk b ON b.s = a.s AND b.seq = a.seq + 1 WHERE a.r = 'user' AND b.r IS DISTINCT FROM 'assistant'))
SELECT s AS session_id, CAST(seq AS INTEGER) AS seq_no, u AS uuid FROM walk WHERE s IN (SELECT s FROM sound)
""",
}
