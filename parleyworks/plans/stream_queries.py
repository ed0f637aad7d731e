"""Transcripts to exchanges, and windows over streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import Workspace, table
from ..sources import transcripts as X
from ..streaming import ingest as I
from . import views as V

Q, O = {}, {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        Q[name] = f
        if oracle:
            O[name] = oracle
        return f

    return keep


_B = "E' \\t\\r\\n\\f\\v'"


SESSION_MESSAGES = f"""m AS (SELECT nullif(lower(trim(sessionId, {_B})), '') AS file, nullif(lower(trim(uuid, {_B})), '') AS uuid, type AS role, coalesce(timestamp, '') AS seen,
  trim(coalesce(CASE WHEN trim(message.content) LIKE '[%' AND json_valid(message.content) THEN array_to_string(list_transform(list_filter(CAST(json_extract(message.content, '$[*]') AS JSON[]), lambda b: json_extract_string(b, '$.type') = 'text'), lambda b: coalesce(json_extract_string(b, '$.text'), '')), chr(10)) ELSE message.content END, '')) AS text,
  coalesce(CASE WHEN trim(message.content) LIKE '[%' AND json_valid(message.content) THEN len(list_filter(CAST(json_extract(message.content, '$[*]') AS JSON[]), lambda b: json_extract_string(b, '$.type') = 'tool_use')) END, 0) AS tools FROM short_conversation WHERE type IN ('user', 'assistant')),
u AS (SELECT DISTINCT ON (file, uuid) * FROM m WHERE file IS NOT NULL AND uuid IS NOT NULL AND (text <> '' OR tools > 0) ORDER BY file, uuid, seen, text)"""


@query("src1_exchanges", f"""
WITH {SESSION_MESSAGES},
g AS (SELECT *, sum(CAST(role = 'user' AND text <> '' AS INTEGER)) OVER (PARTITION BY file ORDER BY seen, uuid ROWS UNBOUNDED PRECEDING) AS turn FROM u)
SELECT file, max(CASE WHEN role = 'user' AND text <> '' THEN text END) AS user_message, string_agg(CASE WHEN role = 'assistant' AND text <> '' THEN text END, chr(10) || chr(10) ORDER BY seen, uuid) AS assistant_message, CAST(sum(tools) AS BIGINT) AS tools
FROM g WHERE turn > 0 GROUP BY file, turn HAVING count(*) FILTER (role = 'assistant' AND text <> '') > 0""")
def _(s, d):
    """Messages of each session in order of time as exchanges."""
    raw = table(s, d, "short_conversation").where(F.col("type").isin("user", "assistant"))
    content = F.col("message.content")
    blocks = F.from_json(content, "array<struct<type:string,id:string,name:string>>")
    m = raw.select(
        V.norm_id("sessionId").alias("file"), V.norm_id("uuid").alias("uuid"), F.col("type").alias("role"), F.coalesce("timestamp", F.lit("")).alias("at"), F.trim(F.coalesce(X.block_text(content), F.lit(""))).alias("text"),
        F.coalesce(F.filter(blocks, lambda b: b["type"] == "tool_use"), F.array().cast("array<struct<type:string,id:string,name:string>>")).alias("tools"), "timestamp",
    ).where("file is not null and uuid is not null and (text != '' or size(tools) > 0)")
    once = m.groupBy("file", "uuid").agg(F.min_by(F.struct("role", "at", "text", "tools", "timestamp"), F.struct("at", "text")).alias("r")).select("file", "uuid", "r.*")
    found = X.exchanges(once, Workspace(s, "src1"), ["at", "uuid"])
    return found.select("file", "user_message", "assistant_message", F.size("tools").cast("bigint").alias("tools"))


@query("x_hourly_events", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(s, d):
    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return I.windowed_counts(e, "ts", "1 hour", None, ["event_type"]).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("x_stream_hourly_events", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(s, d):
    """The same counts by a stream that is read to its end, every window emitted."""
    ws = Workspace(s, "hourly")
    path = f"{d}/events.parquet"
    e = I.table_stream(s, path, s.read.parquet(path).schema).withColumn("ts", F.col("ts").cast("timestamp"))
    out, progress = ws.child("out"), ws.child("progress")
    counts = I.windowed_counts(e, "ts", "1 hour", None, ["event_type"], "10 minutes")

    def keep(batch, _):
        # complete results of each trigger; the last one stands
        batch.write.mode("overwrite").parquet(out)

    counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(out).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("x_user_sessions", """SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (
  SELECT *, CAST(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '30 minutes' AS INTEGER) AS new FROM events)) GROUP BY user_id, k""")
def _(s, d):
    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return I.sessions(e, "ts", "30 minutes", "user_id").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("x_stream_repeats", "SELECT event_id FROM events")
def _(s, d):
    """A stream delivered twice, each event kept once."""
    ws = Workspace(s, "repeats")
    path = f"{d}/events.parquet"
    schema = s.read.parquet(path).schema
    one, two = (I.table_stream(s, path, schema).withColumn("ts", F.col("ts").cast("timestamp")) for _ in range(2))
    out = ws.child("out")
    I.run_to_end(I.without_repeats(one.unionByName(two), ["event_id"], "ts", "365 days").select("event_id"), out, ws.child("progress"))
    return s.read.parquet(out)


QUERIES, ORACLE = Q, O
