"""Limits and defaults, from arguments or the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class EngineConfig:
    """Fixed defaults; each may be set by an environment variable of the same name in upper case."""

    default_search_limit: int = 10
    default_query_limit: int = 20
    default_cluster_limit: int = 15
    max_search_results: int = 10_000
    max_query_entries: int = 10_000
    max_infer_entries: int = 10_000
    max_query_values: int = 1_000
    index_body: bool = False
    index_body_max_bytes: int = 65_536
    fetch_workers: int = 16
    client_timeout_s: float = 10.0

    @classmethod
    def from_env(cls) -> EngineConfig:
        given = {}
        for f in fields(cls):
            text = os.environ.get(f.name.upper())
            if text:
                kind = type(f.default)
                given[f.name] = text.lower() in ("1", "true", "yes") if kind is bool else kind(text)
        return cls(**given)
