"""One check query per operator: a Spark callable and, for DuckDB, the SQL it has to equal."""

from . import analytics, matrix, sources, sql, validation

_MODULES = (sources, sql, matrix, validation, analytics)


def all_queries() -> dict:
    return {key: run for module in _MODULES for key, run in module.QUERIES.items()}


def all_oracles() -> dict:
    return {key: text for module in _MODULES for key, text in module.ORACLE.items()}
