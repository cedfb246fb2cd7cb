"""Named queries over the given tables, each next to the SQL that checks it."""

from __future__ import annotations

import functools
from collections.abc import Callable

from ..session import apply_size_settings, apply_skew_settings

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query ``(spark, sf_dir) -> DataFrame`` with its checking SQL, if there is one."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        @functools.wraps(fn)
        def run(spark, sf_dir):
            apply_skew_settings(spark)
            apply_size_settings(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def load() -> None:
    from . import (  # noqa: F401
        aggregates, composites, joins, projections, reshapes, series, sources, windows,
    )
