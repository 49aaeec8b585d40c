"""Readers for the tables of a capture."""

from .tables import latest_entries, read_table, ship_package, spread, stage

__all__ = ["latest_entries", "read_table", "ship_package", "spread", "stage"]
