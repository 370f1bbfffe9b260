"""All queries of the core and the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

MODULES = ("records", "texts", "reviews", "analyses", "mapping", "reports", "corrections", "media")

QUERIES: dict = {}
SQL: dict = {}
for _name in MODULES:
    _module = import_module(f"scrivener.plans.{_name}")
    QUERIES.update(_module.QUERIES)
    SQL.update(_module.SQL)
