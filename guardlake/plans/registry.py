"""Registry of named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from guardlake.plans.inputs import Tables


class Query(NamedTuple):
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a function from Tables to a DataFrame under `name`."""
    def add(build: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"Query registered twice: {name}")
        REGISTRY[name] = Query(name, build, sql)
        return build

    return add


def load_all() -> dict[str, Query]:
    """Import every plan module and return the registry."""
    from guardlake.plans import (auditing, detection, leaks, learning, limits,  # noqa: F401
                                 multiturn, policies, redaction, requests, screening, streams)
    return REGISTRY


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return load_all()[name].build(Tables(spark, folder))
