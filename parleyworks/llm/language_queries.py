"""Missing and wrong language labels of messages and facts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import norm_id
from ..session import table
from .language import Model, label_code, segments, train


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src_table, row_id, text) of every message and fact; an id counts once, by its last row."""
    ex = table(spark, sf_dir, "exchanges").select(F.lit("exchanges").alias("src_table"), norm_id("id").alias("row_id"), F.col("user_message").alias("text"), F.col("last_indexed").cast("string").alias("at"))
    facts = table(spark, sf_dir, "sync_fact").select(F.lit("sync_fact").alias("src_table"), norm_id("id").alias("row_id"), F.col("fact").alias("text"), F.col("updated_at").alias("at"))
    both = ex.unionByName(facts).where("row_id is not null")
    return both.groupBy("src_table", "row_id").agg(F.max_by("text", F.struct(F.coalesce("at", F.lit("")), F.coalesce("text", F.lit("")))).alias("text"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src_table, row_id, label): the language code that the label names, null if it names none."""

    @F.pandas_udf("string")
    def code(s: pd.Series) -> pd.Series:
        return s.map(label_code)

    raw = table(spark, sf_dir, "lang_labels").select(F.lower(F.trim("src_table")).alias("src_table"), norm_id("row_id").alias("row_id"), "lang_label")
    return raw.groupBy("src_table", "row_id").agg(F.max("lang_label").alias("lang_label")).select("src_table", "row_id", code("lang_label").alias("label"))


def trained(spark: SparkSession, sf_dir: str) -> Model:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "text")
    return train(docs)


def p6_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of one language of every message and fact, with its language and confidence."""
    return segments(items(spark, sf_dir), trained(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = segments(items(spark, sf_dir), trained(spark, sf_dir), sentences=True)
    found = whole.groupBy("src_table", "row_id").agg(F.array_sort(F.collect_set("lang")).alias("langs"))
    judged = found.join(labels(spark, sf_dir), ["src_table", "row_id"], "left")
    right = (F.size("langs") == 1) & F.coalesce(F.col("label") == F.col("langs")[0], F.lit(False))
    return judged.where(~right).select("src_table", "row_id", F.explode("langs").alias("lang"))


QUERIES = {"p6_found": p6_found, "p6_segments": p6_segments}
ORACLE: dict[str, str] = {}
