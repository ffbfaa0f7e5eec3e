"""Named queries over the test tables, one per operator."""

from codefindings.catalog.registry import ORACLES, QUERIES


def _load():
    from codefindings.catalog import basics, findings, pipelines, scans  # noqa: F401


def queries():
    _load()
    return dict(QUERIES)


def oracle_sql():
    _load()
    return dict(ORACLES)
