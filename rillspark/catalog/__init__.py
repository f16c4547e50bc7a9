"""The registry of queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from rillspark.sources.views import Views, with_views


@dataclass(frozen=True)
class Entry:
    run: Callable[[Views], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    """Register ``run(views)`` under a name, with the SQL that must give the same rows."""

    def add(run):
        if name in REGISTRY:
            raise ValueError(f"query registered twice: {name}")
        REGISTRY[name] = Entry(run, with_views(sql) if sql else None)
        return run

    return add


def load() -> dict[str, Entry]:
    from rillspark.catalog import (  # noqa: F401  (importing registers the queries)
        aggregates,
        joins,
        models,
        preparation,
        projections,
        scalars,
        scans,
        series,
    )

    return REGISTRY
