"""All registered queries and their oracle statements."""

from __future__ import annotations

import functools

from tessera.plans import io_queries, metric_queries, ops_queries, retrieval_queries, text_queries
from tessera.session import ship_package

_MODULES = [metric_queries, text_queries, retrieval_queries, ops_queries, io_queries]


def _shipped(fn):
    """Every registered query first makes the package importable on the
    executors (once per application)."""
    @functools.wraps(fn)
    def run(spark, sf_dir):
        ship_package(spark)
        return fn(spark, sf_dir)

    return run


def queries() -> dict:
    out = {}
    for m in _MODULES:
        out.update({k: _shipped(v) for k, v in m.QUERIES.items()})
    return out


def oracle_sql() -> dict:
    out = {}
    for m in _MODULES:
        out.update({k: v.strip() for k, v in m.ORACLE_SQL.items()})
    return out
