"""The tables as the operators see them, and the same views as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import norm_id
from ..functions.text import category_of
from ..operators.tables import latest
from ..schema import RELATIONS
from ..session import table


def exchanges(spark: SparkSession, d: str) -> DataFrame:
    """One row per id, the last indexed."""
    ex = table(spark, d, "exchanges").withColumn("id", norm_id("id")).where("id is not null")
    return latest(ex, ["id"], [F.desc_nulls_last("last_indexed")])


def exchange_meta(spark: SparkSession, d: str) -> DataFrame:
    """Exchanges without their texts and vectors: the columns that reports need."""
    cols = ["id", "project", "timestamp", "archive_path", "line_start", "line_end", "last_indexed", "is_sidechain", "session_id", "cwd", "git_branch", "coding_agent"]
    ex = table(spark, d, "exchanges").select(*cols).withColumn("id", norm_id("id")).where("id is not null")
    return latest(ex, ["id"], [F.desc_nulls_last("last_indexed")])


def calls(spark: SparkSession, d: str) -> DataFrame:
    """Tool calls, repeated rows once."""
    return table(spark, d, "tool_calls").withColumn("exchange_id", norm_id("exchange_id")).distinct()


def log(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "relation_resolution_log")
    ids = {c: norm_id(c) for c in ("source_fact_id", "target_fact_id", "deactivated_fact_id", "survivor_fact_id")}
    return raw.withColumns(ids).withColumn("relation_type_before", F.upper(F.trim("relation_type_before"))).withColumn("action", F.lower(F.trim("action")))


def facts(spark: SparkSession, d: str) -> DataFrame:
    """One row per id, the last updated; a fact that a decision deactivated is inactive."""
    raw = table(spark, d, "sync_fact").withColumn("id", norm_id("id")).where("id is not null")
    last = latest(raw, ["id"], [F.desc_nulls_last("updated_at"), F.col("fact")])
    gone = log(spark, d).where("deactivated_fact_id is not null").select(F.col("deactivated_fact_id").alias("id"), F.lit(True).alias("gone")).distinct()
    return last.join(gone, "id", "left").select(
        "id", "fact", category_of("category").alias("category"), "scope_type", "scope_project", F.from_json("source_exchange_ids", "array<string>").alias("source_exchange_ids"), "created_at", "updated_at",
        F.coalesce("consolidated_count", F.lit(1)).alias("consolidated_count"), F.col("ontology_category_id").alias("category_id"), F.when(~F.isnan("confidence"), F.col("confidence")).alias("confidence"), F.col("gone").isNull().alias("is_active"),
    )


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Distinct typed edges between different facts, with the first log row that names them."""
    pairs = log(spark, d).where(F.col("relation_type_before").isin(RELATIONS) & (F.col("source_fact_id") != F.col("target_fact_id")))
    return pairs.groupBy(F.col("source_fact_id").alias("source_id"), F.col("relation_type_before").alias("relation_type"), F.col("target_fact_id").alias("target_id")).agg(F.min("id").alias("rel_id"), F.min_by("ts", "id").alias("created_at"))


def categories(spark: SparkSession, d: str) -> DataFrame:
    """Categories that facts name, each in a domain by its number."""
    ids = table(spark, d, "sync_fact").select(F.col("ontology_category_id").alias("category_id")).where("category_id is not null").distinct()
    return ids.withColumn("domain_id", F.concat(F.lit("dom-"), F.pmod(F.regexp_extract("category_id", r"(\d+)$", 1).try_cast("int"), F.lit(7)).cast("string")))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding", "label")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def conversation_lines(spark: SparkSession, d: str) -> DataFrame:
    """Messages as numbered lines of one file per session, in order of time: the shape that the transcript reader works on."""
    m = table(spark, d, "short_conversation").select(norm_id("sessionId").alias("file"), norm_id("uuid").alias("uuid"), "type", "timestamp", F.col("message.content").alias("content"), "isSidechain", "cwd", "gitBranch", "version")
    m = m.where("file is not null and uuid is not null").dropDuplicates(["file", "uuid"])
    return m


_BLANKS = "E' \\t\\r\\n\\f\\v'"

VIEWS = f"""
ex AS (SELECT * EXCLUDE (id), lower(trim(id, {_BLANKS})) AS id FROM exchanges WHERE nullif(trim(id, {_BLANKS}), '') IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY lower(trim(id, {_BLANKS})) ORDER BY last_indexed DESC NULLS LAST) = 1),
calls AS (SELECT DISTINCT * EXCLUDE (exchange_id), nullif(lower(trim(exchange_id, {_BLANKS})), '') AS exchange_id FROM tool_calls),
log AS (SELECT * EXCLUDE (source_fact_id, target_fact_id, deactivated_fact_id, survivor_fact_id, relation_type_before, action),
  nullif(lower(trim(source_fact_id, {_BLANKS})), '') AS source_fact_id, nullif(lower(trim(target_fact_id, {_BLANKS})), '') AS target_fact_id,
  nullif(lower(trim(deactivated_fact_id, {_BLANKS})), '') AS deactivated_fact_id, nullif(lower(trim(survivor_fact_id, {_BLANKS})), '') AS survivor_fact_id,
  upper(trim(relation_type_before)) AS relation_type_before, lower(trim(action)) AS action FROM relation_resolution_log),
last_fact AS (SELECT *, lower(trim(id, {_BLANKS})) AS fid FROM sync_fact WHERE nullif(trim(id, {_BLANKS}), '') IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY lower(trim(id, {_BLANKS})) ORDER BY updated_at DESC NULLS LAST, fact ASC NULLS FIRST) = 1),
facts AS (SELECT fid AS id, fact,
  CASE WHEN lower(trim(category)) IN ('decision','preference','pattern','knowledge','constraint') THEN lower(trim(category))
       WHEN lower(trim(category)) IN ('requirement','requirements') THEN 'constraint'
       ELSE coalesce(CASE WHEN contains(lower(trim(category)), '|') THEN list_filter(list_transform(string_split(lower(trim(category)), '|'), lambda x: trim(x)), lambda x: x IN ('decision','preference','pattern','knowledge','constraint'))[1] END, 'knowledge') END AS category,
  scope_type, scope_project, CAST(source_exchange_ids AS JSON) AS src, created_at, updated_at, coalesce(consolidated_count, 1) AS consolidated_count, ontology_category_id AS category_id,
  CASE WHEN NOT isnan(confidence) THEN confidence END AS confidence,
  fid NOT IN (SELECT deactivated_fact_id FROM log WHERE deactivated_fact_id IS NOT NULL) AS is_active FROM last_fact),
edges AS (SELECT source_fact_id AS source_id, relation_type_before AS relation_type, target_fact_id AS target_id, min(id) AS rel_id, arg_min(ts, id) AS created_at FROM log
  WHERE relation_type_before IN ('INFLUENCES','SUPERSEDES','SUPPORTS','CONTRADICTS','DEPENDS_ON','DERIVED_FROM') AND source_fact_id <> target_fact_id GROUP BY ALL),
cats AS (SELECT DISTINCT ontology_category_id AS category_id, 'dom-' || (CAST(regexp_extract(ontology_category_id, '(\\d+)$', 1) AS INTEGER) % 7) AS domain_id FROM sync_fact WHERE ontology_category_id IS NOT NULL)
"""


def sql(body: str, extra: str = "", recursive: bool = False) -> str:
    """A query on the views; ``extra`` are further common tables."""
    return f"WITH {'RECURSIVE ' if recursive else ''}{VIEWS}{', ' + extra if extra else ''}\n{body}"
