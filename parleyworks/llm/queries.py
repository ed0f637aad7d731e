"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from . import (
    chunk_queries,
    conversation_queries,
    credential_queries,
    group_queries,
    language_queries,
    leakage_queries,
    mixing_queries,
    neighbour_queries,
    sentence_queries,
)

_MODULES = (group_queries, conversation_queries, credential_queries, chunk_queries, language_queries, neighbour_queries, leakage_queries, mixing_queries, sentence_queries)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
