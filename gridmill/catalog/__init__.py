"""Queries over the test tables, each with equal SQL for a second engine."""

from __future__ import annotations

from gridmill.catalog import (  # noqa: F401
    change_queries,
    join_queries,
    market_queries,
    partition_queries,
    source_queries,
    sync_queries,
)
from gridmill.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
