"""Where the catalogue's modules register their queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return put


def code(text: str, width: int = 7) -> str:
    """SQL for the number that folds.code_of gives."""
    return f"CAST('0x' || substr(md5({text}), 1, {width}) AS BIGINT)"


def digest(name: str, text: str) -> str:
    """SQL for a field of folds.offline_fields."""
    return f"substr(md5('{name}|' || {text}), 1, 8)"
