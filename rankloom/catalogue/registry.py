"""Registration of named queries with their checking SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Runner = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Runner
    check_sql: str | None


QUERIES: dict[str, Entry] = {}


def query(name: str, check_sql: str | None = None) -> Callable[[Runner], Runner]:
    """Register a query; ``check_sql`` is its independent form, where one exists."""
    def add(run: Runner) -> Runner:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name!r}")
        QUERIES[name] = Entry(run, check_sql)
        return run
    return add


def load_all() -> dict[str, Entry]:
    """Import every module that registers queries."""
    from rankloom.catalogue import (  # noqa: F401
        explore, conformance, grids, pages, exams, side, stores, lookups, documents,
    )
    return QUERIES
