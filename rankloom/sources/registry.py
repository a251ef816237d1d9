"""Sources: a description plus a loader that returns canonical-shaped rows.

A refresh is written to a folder of its own before anything reads it. Only when the
whole of it is written and holds rows does it become the source; whatever breaks
before, in whichever partition, leaves the snapshot in place.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rankloom.session import shared_folder

Loader = Callable[[SparkSession], DataFrame]


@dataclass(frozen=True)
class SourceMeta:
    """Identity of a source; its links are the only home of those links."""

    name: str
    exam: str
    level: str
    states: tuple[str, ...] = ()
    data_format: str = "html"
    body_label: str = ""
    website: str = ""
    source_url: str = ""
    optin: bool = False


@dataclass(frozen=True)
class SourceSpec:
    """``cached`` reads the snapshot; ``latest`` parses freshly stored documents."""

    meta: SourceMeta
    cached: Loader
    latest: Loader | None = None

    def load(self, spark: SparkSession, mode: str = "cached", stage: str | None = None
             ) -> DataFrame:
        """Rows of the asked mode; a refresh that is empty or fails gives the snapshot.

        ``stage`` is the folder for written refreshes; it belongs to the caller and
        must last as long as the rows are read (default: a new shared folder).
        """
        if mode == "latest" and self.latest is not None:
            fresh = self._refresh(spark, stage or shared_folder(spark))
            if fresh is not None:
                return fresh
        return self.cached(spark)

    def _refresh(self, spark: SparkSession, stage: str) -> DataFrame | None:
        """The refresh as written and read back; None where it broke or has no rows."""
        path, seen = f"{stage}/{self.meta.name}", Observation(f"refresh {self.meta.name}")
        try:
            fresh = self.latest(spark).observe(seen, F.count(F.lit(1)).alias("rows"))
            # the writer's commit makes a folder whole or leaves it without a success mark
            fresh.write.mode("overwrite").parquet(path)
            if int(seen.get["rows"]):
                return spark.read.schema(fresh.schema).parquet(path)
            warnings.warn(f"refresh of {self.meta.name} is empty", stacklevel=3)
        except (PySparkException, Py4JJavaError) as exc:
            reason = str(exc).splitlines()[0]
            warnings.warn(f"refresh of {self.meta.name} failed: {reason}", stacklevel=3)
        return None


class SourceRegistry:
    """Named sources in registration order."""

    def __init__(self) -> None:
        self._specs: dict[str, SourceSpec] = {}

    def register(self, spec: SourceSpec) -> SourceSpec:
        if spec.meta.name in self._specs:
            raise ValueError(f"duplicate source name: {spec.meta.name!r}")
        self._specs[spec.meta.name] = spec
        return spec

    def get(self, name: str) -> SourceSpec:
        try:
            return self._specs[name]
        except KeyError:
            raise KeyError(f"unknown source {name!r}; known: {self.names()}") from None

    def names(self) -> list[str]:
        return list(self._specs)

    def all(self, include_optin: bool = True) -> list[SourceSpec]:
        return [s for s in self._specs.values() if include_optin or not s.meta.optin]

    def clear(self) -> None:
        self._specs.clear()
