"""Exchanging facts and their graph with another store as files of JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import edge_key
from ..operators.graph import tombstoned
from ..operators.tables import latest
from ..schema import RELATIONS, SYMMETRIC, schema


def export(facts: DataFrame, edges: DataFrame, categories: DataFrame, path: str) -> dict[str, int]:
    """Write active facts, all categories, and the edges whose ends are both active; returns what was written."""
    active = facts.where("is_active")
    ids = active.select("id")
    kept = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    counts = {}
    for name, df in (("facts", active), ("relations", kept), ("categories", categories)):
        df.write.mode("overwrite").json(f"{path}/{name}.jsonl")
        counts[name] = df.sparkSession.read.text(f"{path}/{name}.jsonl").count()
    return counts


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(facts, edges) of an exported folder; unknown columns are ignored."""
    return spark.read.schema(schema("facts")).json(f"{path}/facts.jsonl"), spark.read.schema(schema("edges")).json(f"{path}/relations.jsonl")


def merged(facts: DataFrame, edges: DataFrame, their_facts: DataFrame, their_edges: DataFrame, log: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(new facts, new edges) that an import adds.

    A fact whose id is there is not added; one whose text and scope an active fact or an earlier row of the batch already has is taken
    for that one, and edges follow. Self-loops, kinds that aren't known, edges that exist (either way round for kinds without
    direction) and those that a valid decision removed are dropped. A second import of the same files adds nothing.
    """
    content = ["fact", "scope_type", F.coalesce("scope_project", F.lit(""))]
    key = F.sha2(F.to_json(F.struct(F.col("fact"), F.col("scope_type"), content[2].alias("p"))), 256)
    theirs = their_facts.where("id is not null and fact is not null").withColumn("_key", key)
    fresh = latest(theirs, ["id"], [F.col("created_at")]).join(facts.select("id"), "id", "left_anti")
    ours = facts.where("is_active").select(key.alias("_key"), "id").groupBy("_key").agg(F.min("id").alias("known"))
    first = fresh.groupBy("_key").agg(F.min_by("id", F.struct("created_at", "id")).alias("first"))
    mapped = fresh.join(first, "_key").join(ours, "_key", "left").withColumn("to", F.coalesce("known", "first"))
    new_facts = mapped.where("to = id").drop("_key", "first", "known", "to")
    moves = mapped.where("to != id").select("id", "to")

    def follow(df: DataFrame, end: str) -> DataFrame:
        return df.join(moves.select(F.col("id").alias(end), F.col("to").alias("_to")), end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")

    moved = follow(follow(their_edges.where(F.col("relation_type").isin(RELATIONS)), "source_id"), "target_id").where("source_id != target_id")
    all_ids = facts.select("id").unionByName(new_facts.select("id"))
    known = moved.join(all_ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(all_ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    ek = edge_key("relation_type", "source_id", "target_id", SYMMETRIC)
    new = known.withColumn("_key", ek).dropDuplicates(["_key"]).join(edges.select(ek.alias("_key")).distinct(), "_key", "left_anti")
    if log is not None:
        dead = tombstoned(log, facts).select(edge_key("relation_type_before", "source_fact_id", "target_fact_id", SYMMETRIC).alias("_key")).distinct()
        new = new.join(dead, "_key", "left_anti")
    return new_facts, new.drop("_key")
