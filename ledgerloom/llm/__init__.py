"""Operators for large-scale training-data pipelines."""

from ledgerloom.llm.queries import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
