"""Argument graphs as DataFrames: load, check, look up, assemble, lay out and project them for display."""

from argweave.schemas import GraphTables

__all__ = ["GraphTables"]
