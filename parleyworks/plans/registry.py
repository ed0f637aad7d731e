"""All queries of the core, by name, and their SQL."""

from __future__ import annotations

from . import fact_queries, hierarchy_queries, report_queries, rule_queries, search_queries, state_queries, stream_queries

_MODULES = (fact_queries, hierarchy_queries, report_queries, rule_queries, search_queries, state_queries, stream_queries)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
FLAGSHIP = QUERIES["v7_hybrid"]
