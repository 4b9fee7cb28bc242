"""Registry of queries and of the SQL they are compared with."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plotweave.fixtures import oracle
from plotweave.session import configure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_MODULES = ("catalog", "labels", "features", "zones", "text", "discovery", "files", "geometry", "streams")


def query(name: str, sql: str | None = None, **patterns: str) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may name fixtures and tables in braces.

    ``patterns`` are put in place of ``<name>`` afterwards: regular expressions hold braces themselves.
    """

    def register(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(configure(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            plain = oracle(sql)
            for key, pattern in patterns.items():
                plain = plain.replace(f"<{key}>", pattern)
            ORACLES[name] = plain
        return build

    return register


def load(*modules: str) -> None:
    """Import query modules, by default all."""
    for module in modules or _MODULES:
        importlib.import_module(f"plotweave.queries.{module}")
