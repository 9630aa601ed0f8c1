"""Queries over the test tables, each next to the SQL that checks it."""

from catalog.registry import ORACLES, QUERIES
from catalog import files, learning, survival, tables, texts, vectors  # noqa: F401  (registers the queries)

__all__ = ["ORACLES", "QUERIES"]
