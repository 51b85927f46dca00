"""Where queries register themselves: name -> callable, SQL twin, and the survey rows they show."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wardlens.session import prepare
from wardlens.sources.tables import ADAPTER_SQL

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
TWINS: dict[str, str] = {}
COVERS: dict[str, tuple[str, ...]] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``covers`` lists survey rows separated by spaces."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = run
        COVERS[name] = tuple(covers.split())
        if sql is not None:
            TWINS[name] = sql
        return fn

    return register


def with_views(*ctes: str) -> str:
    """``WITH`` clause holding the relational views and further common table expressions."""
    return "with " + ",\n".join([ADAPTER_SQL.strip(), *[c.strip() for c in ctes]]) + "\n"


def with_ctes(*ctes: str) -> str:
    return "with " + ",\n".join(c.strip() for c in ctes) + "\n"


def materialized(sql: str) -> str:
    """The same SQL with each common table expression (one that starts a line) run once, however often it is named."""
    return re.sub(r"(?m)^(with |, )?(\w+) as \(", r"\1\2 as materialized (", sql)
