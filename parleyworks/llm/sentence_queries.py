"""Sentence units of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from .sentences import sentence_units, train


def p10_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unit with its start and end."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentence_units(docs, train(docs))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_units(spark, sf_dir).select("doc_id", "start_pos")


QUERIES = {"p10_found": p10_found, "p10_units": p10_units}
ORACLE: dict[str, str] = {}
