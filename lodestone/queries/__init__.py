"""Registered queries: name -> (spark, folder) -> DataFrame, each beside the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with DuckDB SQL for the same rows."""

    def add(function: Callable) -> Callable:
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


from lodestone.queries import aggregation, corpus, joining, policies, retrieval, scanning, searching, streams, windowing  # noqa: E402,F401
