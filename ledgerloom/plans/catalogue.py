"""All queries of the core and their SQL."""

from __future__ import annotations

from ledgerloom.plans import data_problems, document_queries, entity_queries, import_queries, ledger_queries, page_queries, record_queries, registry_queries, research_queries, search_queries

_MODULES = (data_problems, entity_queries, document_queries, import_queries, ledger_queries, page_queries, record_queries, registry_queries, research_queries, search_queries)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: q for m in _MODULES for k, q in m.SQL.items()}
