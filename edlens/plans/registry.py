"""Named queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from edlens.plans.standins import Tables, with_


@dataclass(frozen=True)
class Registered:
    build: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Registered] = {}


def query(name: str, views: str = "", sql: str | None = None):
    def keep(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Registered(build, with_(views, sql) if sql else None)
        return build

    return keep
