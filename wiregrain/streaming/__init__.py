"""Incremental ingestion."""

from .ingest import current_counts, endpoint_counts, entry_stream, first_versions, replay_counts, start_counts

__all__ = ["current_counts", "endpoint_counts", "entry_stream", "first_versions", "replay_counts", "start_counts"]
