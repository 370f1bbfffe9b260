"""All queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

MODULES = ("queries_topn", "queries_tokens", "queries_pieces", "queries_neighbours", "queries_mixture", "queries_abuse", "queries_language", "queries_scans")

QUERIES: dict = {}
SQL: dict = {}
for _name in MODULES:
    _module = import_module(f"scrivener.llm.{_name}")
    QUERIES.update(_module.QUERIES)
    SQL.update(_module.SQL)
