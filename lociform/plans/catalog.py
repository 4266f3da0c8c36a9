"""All queries by name, and their SQL."""

from __future__ import annotations

import importlib

from lociform.plans.registry import QUERIES, SQL

for _name in ("interval_queries", "lookup_queries", "selection_queries", "sequence_queries", "source_queries", "statistics_queries"):
    importlib.import_module(f"lociform.plans.{_name}")

__all__ = ["QUERIES", "SQL"]
