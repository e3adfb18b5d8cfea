"""Registered queries over the driver's tables."""

from . import curation_queries, gate_queries, metric_queries, pair_queries, record_queries, report_queries, source_queries, text_queries, trace_queries  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
