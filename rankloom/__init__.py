"""Rank-table analytics on Spark: sources, conformance, grid reshaping and queries."""

__version__ = "0.1.0"
