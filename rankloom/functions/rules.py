"""Ordered rules: the first that matches decides. The order is the meaning."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def ladder(rules: Iterable[tuple[Column, object]], default: object = None) -> Column:
    """Chained ``when``: (condition, result) in order, then the default."""
    out = None
    for condition, result in rules:
        out = F.when(condition, result) if out is None else out.when(condition, result)
    if out is None:
        return default if isinstance(default, Column) else F.lit(default)
    return out if default is None else out.otherwise(default)


def first_match(text: Column, rules: Iterable[tuple[str, str]], default: str) -> Column:
    """(label, case-insensitive pattern) in order, then the default label."""
    return ladder(((text.rlike("(?i)" + pattern), label) for label, pattern in rules),
                  default)


def lookup(key: Column, table: dict[str, str], default: Column | str | None = None) -> Column:
    """A small fixed vocabulary as an expression."""
    out = ladder(((key == k, v) for k, v in table.items()), default)
    return out
