"""Named queries of this subpackage, with their checking SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Runner = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Runner] = {}
ORACLES: dict[str, str] = {}
MODULES = ["queries", "search_queries"]


def query(name: str, oracle: str | None = None) -> Callable[[Runner], Runner]:
    """Register ``name``; ``oracle`` is its independent SQL."""
    def add(run: Runner) -> Runner:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name!r}")
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return run
    return add


def load() -> tuple[dict[str, Runner], dict[str, str]]:
    """All queries and their SQL."""
    for module in MODULES:
        import_module(f"rankloom.llm.{module}")
    return QUERIES, ORACLES
