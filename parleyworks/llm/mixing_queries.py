"""Documents mixed by source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import Workspace, table
from .mixing import mixed


def vocabulary() -> str:
    """The ranks of the multilingual byte-level BPE."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares per source."""
    return mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), Workspace(spark, "p9"), vocabulary())[1]


def p9_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen documents, once per pass."""
    return mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), Workspace(spark, "p9"), vocabulary())[0]


QUERIES = {"p9_selection": p9_selection, "p9_report": p9_report}
ORACLE: dict[str, str] = {}
