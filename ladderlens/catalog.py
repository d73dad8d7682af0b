"""Named queries and their DuckDB SQL."""

from __future__ import annotations

from ladderlens.plans import churn_queries, model_queries, pair_queries, panel_queries, source_queries, stat_queries  # noqa: F401
from ladderlens.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
