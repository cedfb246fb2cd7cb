"""Queries of the operators of this subpackage, and the SQL that checks them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from ..session import apply_skew_settings

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``(spark, sf_dir) -> DataFrame`` with its checking SQL, if there is one."""

    def wrap(fn):
        @functools.wraps(fn)
        def run(spark, sf_dir):
            apply_skew_settings(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load() -> None:
    from . import queries  # noqa: F401
