"""All queries of the screening engine, and the SQL that gives the same rows."""

from __future__ import annotations

from gaugewise.plans import comparison_queries, composite_queries, context_queries, contract_queries, layer1_queries, layer2_queries, source_queries

MODULES = [source_queries, layer1_queries, layer2_queries, composite_queries, comparison_queries, context_queries, contract_queries]
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
