"""Transcripts to exchanges.

Two dialects of JSON lines are read: A has one message a line (type, message.role, message.content as text or blocks), B wraps
messages, calls and their results in a payload. Lines that don't parse are skipped. Turns become exchanges by a running count of
user messages along each file, computed as a distributed prefix sum, so neither a long file nor a hot session is one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import encoded_path, exchange_id
from ..operators.hierarchy import prefix_sums
from ..operators.tables import filled_forward, numbered
from ..session import Workspace, skew_safe_lookup
from .files import plain_path

_A = "type string, timestamp string, uuid string, parentUuid string, isSidechain boolean, sessionId string, cwd string, gitBranch string, version string, message struct<role:string,content:string>"
_BLOCKS = "array<struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string,content:string,is_error:boolean>>"
_B = "timestamp string, type string, payload struct<id:string,cwd:string,git:struct<branch:string>,type:string,role:string,content:array<struct<type:string,text:string>>,name:string,namespace:string,call_id:string,arguments:string,input:string,output:string,cli_version:string>"
_B_TYPES = ["session_meta", "turn_context", "response_item", "event_msg", "compacted"]
_A_TYPES = ["user", "assistant", "summary", "system", "file-history-snapshot", "queue-operation"]


def lines(spark: SparkSession, path: str, ws: Workspace, glob: str = "*.jsonl", recursive: bool = True) -> DataFrame:
    """(file, line, text) of every line that isn't blank, lines from 1. An empty folder gives no rows.

    Files are read in splits and numbered by a distributed prefix sum, so a long file is many tasks."""
    reader = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", glob).option("lineSep", "\n")
    found = reader.text(path).select(plain_path("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("text"))
    # a task numbers its lines in order; what it numbers is written once before the numbers are used
    run = prefix_sums(ws, found.withColumn("one", F.lit(1)), ["file", "block", "at"], "one", "before")
    first = run.groupBy("file").agg(F.min("before").alias("first"))
    return skew_safe_lookup(run, first, "file", "inner").where(F.trim("text") != "").select("file", (F.col("before") - F.col("first") + 1).cast("int").alias("line"), "text")


def dialects(raw: DataFrame, within: int = 40) -> DataFrame:
    """(file, dialect): of the first line of a known kind among the first ``within`` lines that parse; A where none is."""
    kind = F.get_json_object("text", "$.type")
    parsed = raw.select("file", "line", kind.alias("kind")).where("kind is not null")
    w = Window.partitionBy("file").orderBy("line")
    first = parsed.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= within)
    known = first.withColumn("dialect", F.when(F.col("kind").isin(_B_TYPES), "B").when(F.col("kind").isin(_A_TYPES), "A")).where("dialect is not null")
    named = known.groupBy("file").agg(F.min_by("dialect", "line").alias("dialect"))
    return raw.select("file").distinct().join(named, "file", "left").select("file", F.coalesce("dialect", F.lit("A")).alias("dialect"))


def block_text(content: Column) -> Column:
    """The text of a message: as it is, or its text blocks joined by line breaks."""
    blocks = F.from_json(content, _BLOCKS)
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), "\n")
    return F.when(F.trim(content).startswith("[") & blocks.isNotNull(), joined).otherwise(content)


def messages_a(raw: DataFrame) -> DataFrame:
    """Dialect A lines as messages: file, line, role, text, tools, and the metadata of the line."""
    m = raw.select("file", "line", F.from_json("text", _A).alias("m")).where(F.col("m.type").isin("user", "assistant"))
    blocks = F.from_json(F.col("m.message.content"), _BLOCKS)
    tools = F.coalesce(F.filter(blocks, lambda b: b["type"] == "tool_use"), F.array().cast(_BLOCKS))
    return m.select(
        "file", "line", F.col("m.type").alias("role"), F.trim(F.coalesce(block_text(F.col("m.message.content")), F.lit(""))).alias("text"),
        F.transform(tools, lambda b: F.struct(b["id"].alias("id"), b["name"].alias("tool_name"), b["input"].alias("tool_input"))).alias("tools"),
        F.col("m.timestamp").alias("timestamp"), F.col("m.sessionId").alias("session_id"), F.col("m.cwd").alias("cwd"), F.col("m.gitBranch").alias("git_branch"), F.col("m.version").alias("version"), F.col("m.isSidechain").alias("is_sidechain"),
    ).where((F.col("text") != "") | (F.size("tools") > 0))


def messages_b(raw: DataFrame, ws: Workspace) -> DataFrame:
    """Dialect B lines as messages; folder and branch are carried on from the lines before, results are joined to calls by call id (the
    first line of a call's counts)."""
    m = raw.select("file", "line", F.from_json("text", _B).alias("m")).where("m.type is not null")
    named = m.select(
        "file", "line", "m", F.col("m.payload.cwd").alias("cwd"), F.col("m.payload.git.branch").alias("git_branch"), F.when(F.col("m.type") == "session_meta", F.col("m.payload.id")).alias("session_id"), F.col("m.payload.cli_version").alias("version")
    )
    carried = filled_forward(ws, named, "file", "line", ["cwd", "git_branch", "session_id", "version"]).where("m.type = 'response_item'")
    kind = F.col("m.payload.type")
    text = F.array_join(F.transform("m.payload.content", lambda b: F.coalesce(b["text"], F.lit(""))), "\n")
    results = carried.where(kind.endswith("_output")).groupBy("file", F.col("m.payload.call_id").alias("call_id")).agg(F.min_by("m.payload.output", "line").alias("tool_result"))
    said = carried.where((kind == "message") & F.col("m.payload.role").isin("user", "assistant")).select(
        "file", "line", F.col("m.payload.role").alias("role"), F.trim(F.coalesce(text, F.lit(""))).alias("text"), F.array().cast("array<struct<id:string,tool_name:string,tool_input:string,tool_result:string>>").alias("tools"), F.col("m.timestamp").alias("timestamp"), "session_id", "cwd", "git_branch", "version",
    )
    called = carried.where(kind.isin("function_call", "custom_tool_call", "local_shell_call")).select("file", "line", F.col("m.payload.call_id").alias("call_id"), F.coalesce("m.payload.name", F.lit("shell")).alias("name"), F.coalesce("m.payload.arguments", "m.payload.input").alias("input"), F.col("m.timestamp").alias("timestamp"), "session_id", "cwd", "git_branch", "version").join(results, ["file", "call_id"], "left")
    calls = called.select("file", "line", F.lit("assistant").alias("role"), F.lit("").alias("text"), F.array(F.struct(F.col("call_id").alias("id"), F.col("name").alias("tool_name"), F.col("input").alias("tool_input"), "tool_result")).alias("tools"), "timestamp", "session_id", "cwd", "git_branch", "version")
    return said.unionByName(calls).withColumn("is_sidechain", F.lit(False)).where((F.col("text") != "") | (F.size("tools") > 0))


def exchanges(messages: DataFrame, ws: Workspace, order: list[str] | None = None) -> DataFrame:
    """(file, turn, first, last, user_message, assistant_message, tools, ...): a user message with what assistants said until the next.

    ``order`` are the columns that order the messages of a file, the line by default. Assistant texts are joined by an empty line; a
    turn without any is left out, and so is what comes before a file's first user message. Metadata is the last that an assistant
    line has.
    """
    order = order or ["line"]
    opened = messages.withColumn("opens", ((F.col("role") == "user") & (F.col("text") != "")).cast("int")).withColumn("_order", F.struct(*order))
    run = prefix_sums(ws, opened, ["file", *order], "opens", "before").withColumn("turn", F.col("before") + F.col("opens"))
    # a turn's number runs on over the files: what has no user message in its own file is told apart by the first one's file
    by = run.groupBy("file", "turn").agg(
        F.max("opens").alias("opens"),
        F.min(F.struct("_order")).alias("first"), F.max(F.struct("_order")).alias("last"),
        F.max(F.when(F.col("opens") == 1, F.col("text"))).alias("user_message"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("role") == "assistant") & (F.col("text") != ""), F.struct("_order", "text")))), lambda x: x["text"]), "\n\n").alias("assistant_message"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.size("tools") > 0, F.struct("_order", "tools")))), lambda x: x["tools"])).alias("tools"),
        *[F.max_by(c, F.when((F.col("role") == "assistant") & F.col(c).isNotNull(), F.col("_order"))).alias(c) for c in ("timestamp", "session_id", "cwd", "git_branch", "version") if c in messages.columns],
    )
    return by.where("opens = 1 and assistant_message != ''").drop("opens")


def indexed(found: DataFrame) -> DataFrame:
    """Exchanges read from files as rows of the exchanges table: id, project (the file's folder), archive path and lines."""
    parts = F.split("file", "/")
    return found.select(
        exchange_id("file", "first._order.line", "last._order.line").alias("id"), F.element_at(parts, -2).alias("project"), "timestamp", "user_message", "assistant_message", F.col("file").alias("archive_path"),
        F.col("first._order.line").alias("line_start"), F.col("last._order.line").alias("line_end"), "session_id", "cwd", "git_branch", "tools",
    )


def excluded_files(raw: DataFrame, markers: list[str]) -> DataFrame:
    """Files with any of the markers on any line."""
    hit = F.lit(False)
    for m in markers:
        hit = hit | F.col("text").contains(m)
    return raw.where(hit).select("file").distinct()


def file_projects(raw: DataFrame, excluded: list[str]) -> DataFrame:
    """(file, project, excluded): the slug of the first folder that a file names, and whether any of its folders lies in an excluded one."""
    cwd = F.coalesce(F.get_json_object("text", "$.payload.cwd"), F.get_json_object("text", "$.cwd"))
    named = raw.select("file", "line", cwd.alias("cwd")).where("cwd is not null")
    inside = F.lit(False)
    for x in excluded:
        x = x.rstrip("/")
        inside = inside | (F.col("cwd") == x) | F.col("cwd").startswith(x + "/")
    return named.groupBy("file").agg(encoded_path(F.min_by("cwd", "line")).alias("project"), F.bool_or(inside).alias("excluded"))


def rendered(raw: DataFrame, ws: Workspace, start: int | None = None, end: int | None = None, ahead: int = 5) -> DataFrame:
    """(file, markdown): the conversation from line ``start`` to ``end`` (both included) as Markdown, tool results beside their calls
    if they follow within ``ahead`` messages."""
    kept = raw.where((F.col("line") >= (start or 1)) & (F.col("line") <= (end or 2**31 - 1)))
    m = kept.select("file", "line", F.from_json("text", _A).alias("m")).where(F.col("m.type").isin("user", "assistant"))
    blocks = F.from_json("m.message.content", _BLOCKS)
    base = numbered(ws, m, ["file"], ["line"], "no").select("file", "line", "no", F.col("m.type").alias("role"), F.coalesce("m.isSidechain", F.lit(False)).alias("side"), block_text(F.col("m.message.content")).alias("text"), blocks.alias("blocks"))
    uses = base.select("file", "line", "no", F.explode(F.filter("blocks", lambda b: b["type"] == "tool_use")).alias("u"))
    results = base.select("file", F.col("no").alias("at"), F.explode(F.filter("blocks", lambda b: b["type"] == "tool_result")).alias("r")).select("file", "at", F.col("r.tool_use_id").alias("use"), F.col("r.content").alias("result"))
    joined = uses.join(results, (uses["file"] == results["file"]) & (F.col("u.id") == F.col("use")) & F.col("at").between(F.col("no") + 1, F.col("no") + ahead), "left").select(uses["file"], "line", F.concat(F.lit("\n\n**"), F.col("u.name"), F.lit("** `"), F.coalesce("u.input", F.lit("")), F.lit("`"), F.coalesce(F.concat(F.lit("\n\n```\n"), F.col("result"), F.lit("\n```")), F.lit(""))).alias("tool"))
    tools = joined.groupBy("file", "line").agg(F.array_join(F.sort_array(F.collect_list("tool")), "").alias("tools"))
    who = F.concat(F.lit("## "), F.initcap("role"), F.when(F.col("side"), F.lit(" (sidechain)")).otherwise(F.lit("")))
    part = F.concat(who, F.when(F.trim("text") != "", F.concat(F.lit("\n\n"), F.col("text"))).otherwise(F.lit("")), F.coalesce("tools", F.lit("")))
    return base.join(tools, ["file", "line"], "left").select("file", "line", part.alias("part")).groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "part"))), lambda x: x["part"]), "\n\n").alias("markdown"))
