"""Named queries of this package, with their SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
MODULES = ['mixing', 'sharding', 'licenses', 'fingerprints', 'packing', 'neardup', 'rules',
           'quality', 'pii', 'katz', 'linededup', 'negatives', 'centroids']


def query(name: str, sql: str | None = None):
    """Register ``function(spark, sf_dir) -> DataFrame`` under ``name``."""
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return register


def load():
    for module in MODULES:
        import_module(f'codefindings.llm.{module}')


def queries() -> dict:
    load()
    import corpus_pipeline
    return {**QUERIES, 'pipeline': corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    load()
    import corpus_pipeline
    extra = {'pipeline': corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return {**ORACLES, **extra}
