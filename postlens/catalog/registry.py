"""The registered queries, in the order they are declared."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Run
    check: str | None


QUERIES: dict[str, Query] = {}


def query(check: str | None = None) -> Callable[[Run], Run]:
    """Register a query under its function name, with its check SQL if SQL can say it."""

    def add(run: Run) -> Run:
        QUERIES[run.__name__] = Query(run.__name__, run, check)
        return run

    return add
