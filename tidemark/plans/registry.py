"""Named queries with, where SQL can say the same, the statement that checks them."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Entry(NamedTuple):
    run: Query
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name."""

    def add(run: Query) -> Query:
        if run.__name__ in ENTRIES:
            raise ValueError(f"query {run.__name__} exists")
        ENTRIES[run.__name__] = Entry(run, sql)
        return run

    return add


def load() -> dict[str, Entry]:
    from tidemark.plans import checks_queries, feature_queries, report_queries, source_queries, stream_queries  # noqa: F401

    return ENTRIES
