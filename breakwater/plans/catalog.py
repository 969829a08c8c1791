"""All registered queries."""

from __future__ import annotations

from . import queries_annotate, queries_cluster, queries_count, queries_filter, queries_scan  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
