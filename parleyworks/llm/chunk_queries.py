"""Pieces of oversized messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import norm_id
from ..session import table
from .chunking import LIMIT, OVERLAP, split_texts


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(exchange_id, field, text) of both messages of every row of ``exchanges``."""
    ex = table(spark, sf_dir, "exchanges").where("id is not null").select(norm_id("id").alias("exchange_id"), "user_message", "assistant_message")
    pair = F.array(F.struct(F.lit("user_message").alias("field"), F.col("user_message").alias("text")), F.struct(F.lit("assistant_message").alias("field"), F.col("assistant_message").alias("text")))
    return ex.select("exchange_id", F.explode(pair).alias("m")).select("exchange_id", "m.field", "m.text")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every long message: at most 2,000 characters each, 200 of them shared with the piece before."""
    return split_texts(messages(spark, sf_dir)).select("exchange_id", "field", "piece_no", "start_pos", "end_pos", "piece").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_texts(messages(spark, sf_dir)).where("piece_no = 2").select("exchange_id", "field").distinct()


def p5_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pieces of every long message come to: its length and fingerprint when put together, pieces above the limit, and pieces
    that don't begin with the last 200 characters of the one before."""
    in_message = Window.partitionBy("exchange_id", "field").orderBy("piece_no")
    before = F.lag("end_pos").over(in_message)
    cut = p5_pieces(spark, sf_dir).select(
        "*", F.length("piece").alias("size"), F.coalesce(F.col("start_pos") != before + 1 - OVERLAP, F.col("start_pos") != 1).cast("int").alias("off"),
        F.expr("substring(piece, coalesce(lag(end_pos) OVER (PARTITION BY exchange_id, field ORDER BY piece_no), 0) - start_pos + 2)").alias("own"),
    )
    return cut.groupBy("exchange_id", "field").agg(
        F.max("end_pos").cast("bigint").alias("chars"), F.sum(F.when(F.col("size") > LIMIT, 1).otherwise(0)).alias("too_long"), F.sum("off").alias("wrong_overlap"),
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "own"))), lambda p: p["own"]), "").cast("binary")).alias("fingerprint"),
    )


QUERIES = {"p5_found": p5_found, "p5_pieces": p5_pieces, "p5_rebuilt": p5_rebuilt}

ORACLE = {
    "p5_found": """
SELECT DISTINCT lower(trim(id, E' \\t\\r\\n\\f\\v')) AS exchange_id, field FROM (
  SELECT id, 'user_message' AS field, user_message AS t FROM exchanges UNION ALL SELECT id, 'assistant_message', assistant_message FROM exchanges)
WHERE length(t) > 2000
""",
    "p5_rebuilt": """
SELECT DISTINCT lower(trim(id, E' \\t\\r\\n\\f\\v')) AS exchange_id, field, length(t) AS chars, CAST(0 AS BIGINT) AS too_long, CAST(0 AS BIGINT) AS wrong_overlap, md5(t) AS fingerprint
FROM (SELECT id, 'user_message' AS field, user_message AS t FROM exchanges UNION ALL SELECT id, 'assistant_message', assistant_message FROM exchanges)
WHERE length(t) > 2000
""",
}
