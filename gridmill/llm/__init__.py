"""Operators for preparing training data, and their queries."""

from __future__ import annotations

from gridmill.llm import queries  # noqa: F401
from gridmill.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
