"""All registered queries."""

from . import fact_queries, graph_queries, memory_queries, observing_queries, retrieval_queries, stream_queries  # noqa: F401
from .registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES", "query"]
