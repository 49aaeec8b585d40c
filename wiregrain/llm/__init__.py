"""Operators for text corpora. Nothing else in the package imports this."""

from .queries import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
