"""All queries of the reference's operators, with their SQL counterparts."""

from __future__ import annotations

from scimap.plans import counts, graph_queries, outputs, statistics, texts
from scimap.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "counts", "graph_queries", "outputs", "statistics", "texts"]
