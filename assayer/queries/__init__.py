"""Registered queries, each next to the SQL that gives the same result."""

from __future__ import annotations

from assayer.queries.registry import all_queries, all_sql

__all__ = ["all_queries", "all_sql"]
