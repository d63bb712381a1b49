"""Registered queries and their SQL."""

from tidemark.catalog import cycle, experiments, ledger, market, sequential, stores, streams  # noqa: F401
from tidemark.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
