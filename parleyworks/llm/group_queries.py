"""Groups of facts linked by judged relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import norm_id
from ..session import Workspace, table
from .components import connected_groups

#: The relation types whose pairs count as matches.
LINKING_TYPES = ["SUPERSEDES", "CONTRADICTS"]


def fact_links(spark: SparkSession, sf_dir: str, ws: Workspace) -> DataFrame:
    """(a, b): ends of log rows of a linking type, both ids of facts."""
    log = table(spark, sf_dir, "relation_resolution_log")
    kind = F.upper(F.coalesce(norm_id("relation_type_before"), F.lit("")))
    pairs = log.where(kind.isin(LINKING_TYPES)).select(norm_id("source_fact_id").alias("a"), norm_id("target_fact_id").alias("b")).where("a != b")
    facts = table(spark, sf_dir, "sync_fact").select(norm_id("id").alias("id")).where("id is not null").distinct()
    unique = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return unique.join(facts.withColumnRenamed("id", "a"), "a", "left_semi").join(facts.withColumnRenamed("id", "b"), "b", "left_semi")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "p1")
    groups = connected_groups(fact_links(spark, sf_dir, ws), ws)
    return groups.select(F.col("group").alias("group_fact_id"), F.col("id").alias("fact_id"))


QUERIES = {"p1_found": p1_found}

ORACLE = {
    "p1_found": """
WITH RECURSIVE facts AS (SELECT DISTINCT lower(trim(id, E' \\t\\r\\n\\f\\v')) AS id FROM sync_fact WHERE id IS NOT NULL),
pairs AS (
  SELECT DISTINCT lower(trim(source_fact_id, E' \\t\\r\\n\\f\\v')) AS a, lower(trim(target_fact_id, E' \\t\\r\\n\\f\\v')) AS b
  FROM relation_resolution_log WHERE upper(trim(relation_type_before, E' \\t\\r\\n\\f\\v')) IN ('SUPERSEDES', 'CONTRADICTS')),
links AS (
  SELECT a, b FROM pairs WHERE a <> b AND a IN (SELECT id FROM facts) AND b IN (SELECT id FROM facts)),
arcs AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS id, a AS seen FROM arcs UNION SELECT r.id, x.b FROM reach r JOIN arcs x ON x.a = r.seen)
SELECT min(seen) AS group_fact_id, id AS fact_id FROM reach GROUP BY id
""",
}
