"""Registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from . import bodies, problems, reference

_MODULES = (problems, reference, bodies)


def all_queries() -> dict:
    return {k: q for m in _MODULES for k, q in m.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {k: q for m in _MODULES for k, q in m.ORACLES.items()}
