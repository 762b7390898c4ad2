"""All queries of the core and their SQL twins."""

from __future__ import annotations

from tablewright.plans import detail_queries, document_queries, name_queries, quality_queries, structure_queries, table_queries, text_queries

FLAGSHIP = "d10_infer_types"
_MODULES = [table_queries, text_queries, detail_queries, document_queries, structure_queries, name_queries, quality_queries]
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
