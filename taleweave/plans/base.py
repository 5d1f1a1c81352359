"""Registration of queries with their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from taleweave.sources import bridge

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, recursive: bool = False):
    """Register a function under its name; ``sql`` goes on after the book's views."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            body = sql.strip()
            more = f",\n{body[5:].lstrip()}" if body.upper().startswith("WITH ") else f"\n{body}"
            ORACLES[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{bridge.SQL.strip()}{more}"
        return f

    return add
