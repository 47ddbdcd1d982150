"""Registration of queries beside their oracles."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}  # further named subqueries for the oracles


class Tables:
    """The driver's tables and the views derived from them, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in inputs.VIEWS:
            return inputs.view(self.spark, self.sf_dir, name)
        return inputs.table(self.spark, self.sf_dir, name)


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the views it names as ``v_<name>``, in dependency order."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bv_(\w+)", text):
            if name in order:
                continue
            body = CTES[name] if name in CTES else inputs.view_sql(name)
            visit(body)
            if name not in order:
                order.append(name)

    visit(sql)
    if not order:
        return sql
    bodies = [f"v_{n} AS ({CTES[n] if n in CTES else inputs.view_sql(n)})" for n in order]
    return f"WITH {', '.join(bodies)} {sql}"


def query(name: str, oracle: str | None = None):
    """Register ``build(tables) -> DataFrame`` under ``name`` with its oracle SQL."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register
