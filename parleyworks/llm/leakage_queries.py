"""Evaluation passages in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import Workspace, table
from .leakage import INVISIBLE, leaked


def p8_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the items of which it holds a passage, edited by a word or two at most, with the least number of edits."""
    return leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), Workspace(spark, "p8"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_near(spark, sf_dir).where("errors = 0").select("doc_id", "item_id")


QUERIES = {"p8_found": p8_found, "p8_near": p8_near}

# The forms of characters that the test tables have, as SQL has no compatibility form: invisible ones dropped, full-width ones made plain.
_WIDE = "".join(chr(0xFF01 + k) for k in range(94)), "".join(chr(0x21 + k) for k in range(94)).replace("'", "''")
_PLAIN = f"nfc_normalize(lower(replace(translate(regexp_replace(text, '{INVISIBLE}', '', 'g'), '{_WIDE[0]}', '{_WIDE[1]}'), 'ß', 'ss')))"

ORACLE = {
    "p8_found": f"""
WITH words AS (SELECT src, id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (
  SELECT src, id, regexp_extract_all({_PLAIN}, '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}\\p{{M}}]*') AS w FROM (SELECT 0 AS src, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM eval_items))),
runs AS (SELECT src, id, string_agg(word, ' ') OVER (PARTITION BY src, id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS run, count(*) OVER (PARTITION BY src, id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS n FROM words)
SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM runs d JOIN runs i ON d.run = i.run AND d.src = 0 AND i.src = 1 AND d.n = 12 AND i.n = 12
""",
}
