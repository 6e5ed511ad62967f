"""Query registry: a callable over (spark, sf_dir) and its SQL twin."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rookery.session import tune
from rookery.sources.tables import oracle

Runner = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Runner] = {}
ORACLE: dict[str, str] = {}


def add(name: str, run: Runner, sql: str | None) -> None:
    @functools.wraps(run)
    def tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(tune(spark), sf_dir)

    QUERIES[name] = tuned
    if sql is not None:
        ORACLE[name] = oracle(sql)


def query(sql: str | None = None) -> Callable[[Runner], Runner]:
    """Register a function under its own name."""

    def wrap(run: Runner) -> Runner:
        add(run.__name__, run, sql)
        return run

    return wrap
