"""Credentials in tool calls and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import norm_id
from ..session import table
from .credentials import TRIGGERS, credentials, redacted


def texts_with_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src_table, row_id, field, text) of the three fields that hold code; repeated rows stay."""
    calls = table(spark, sf_dir, "tool_calls").select(
        F.lit("tool_calls").alias("src_table"),
        norm_id("id").alias("row_id"),
        F.explode(F.array(F.struct(F.lit("tool_input").alias("field"), F.col("tool_input").alias("text")), F.struct(F.lit("tool_result").alias("field"), F.col("tool_result").alias("text")))).alias("f"),
    ).select("src_table", "row_id", "f.field", "f.text")
    answers = table(spark, sf_dir, "exchanges").select(
        F.lit("exchanges").alias("src_table"), norm_id("id").alias("row_id"), F.lit("assistant_message").alias("field"), F.col("assistant_message").alias("text")
    )
    return calls.unionByName(answers)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials(texts_with_code(spark, sf_dir)).select("src_table", "row_id", "field", "start_pos").distinct()


def p3_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that hold a credential, masked."""
    masked = texts_with_code(spark, sf_dir).where(F.col("text").rlike(TRIGGERS)).withColumn("masked", redacted("text"))
    return masked.where("masked != text").select("src_table", "row_id", "field", "masked").distinct()


QUERIES = {"p3_found": p3_found, "p3_masked": p3_masked}
ORACLE: dict[str, str] = {}
