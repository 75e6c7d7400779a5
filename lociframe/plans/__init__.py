"""Registered queries over the given tables."""

from lociframe.plans import annotate_queries, correlate_queries, graph_queries, interval_queries, literature_queries, matrix_queries, sequence_queries, set_queries, source_queries, stats_queries, survival_queries  # noqa: F401
from lociframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
