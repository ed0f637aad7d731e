"""The tables' schemas, and fitting a DataFrame to one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Relation types, and those without direction.
RELATIONS = ["INFLUENCES", "SUPERSEDES", "SUPPORTS", "CONTRADICTS", "DEPENDS_ON", "DERIVED_FROM"]
SYMMETRIC = ["SUPPORTS", "CONTRADICTS"]
# Fixed value: the agent of rows that name none.
DEFAULT_AGENT = "claude-code"

#: The tables by name, as DDL.
SCHEMAS = {
    "exchanges": "id string, project string, timestamp string, user_message string, assistant_message string, archive_path string, line_start int, line_end int, last_indexed bigint, parent_uuid string, is_sidechain boolean, session_id string, cwd string, git_branch string, claude_version string, thinking_level string, thinking_disabled boolean, thinking_triggers string, coding_agent string, embedding_version int, embedding array<float>",
    "tool_calls": "id string, exchange_id string, tool_name string, tool_input string, tool_result string, is_error boolean, timestamp string",
    "facts": "id string, fact string, fact_kr string, category string, scope_type string, scope_project string, source_exchange_ids array<string>, created_at string, updated_at string, consolidated_count int, category_id string, confidence double, is_active boolean",
    "edges": "rel_id bigint, source_id string, target_id string, relation_type string, reasoning string, created_at string",
    "revisions": "fact_id string, previous_fact string, new_fact string, reason string, created_at string",
}


def schema(name: str) -> StructType:
    """The schema of a table; needs a session."""
    return StructType.fromDDL(SCHEMAS[name])


def conform(df: DataFrame, schema: StructType, vocabulary: dict[str, list[str]] | None = None) -> DataFrame:
    """``df`` with exactly the schema's columns: missing ones null, others cast where they can be (else null), extra ones dropped.

    ``vocabulary``: allowed values of a column; rows with another value are dropped, null is allowed.
    """
    cols = [F.col(f.name).try_cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    out = df.select(*cols)
    for name, allowed in (vocabulary or {}).items():
        out = out.where(F.col(name).isNull() | F.col(name).isin(allowed))
    return out
