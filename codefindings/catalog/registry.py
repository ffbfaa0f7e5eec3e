"""The list of named queries and their SQL equivalents."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``function(spark, sf_dir) -> DataFrame`` under ``name``, with its SQL if it has one."""
    def register(function):
        if name in QUERIES:
            raise ValueError(f'duplicate query {name}')
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return register
