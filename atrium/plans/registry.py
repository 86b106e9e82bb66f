"""Registry of runnable queries: each has a Spark callable and, where SQL can say it, an oracle."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from atrium.plans.oracle_views import NEEDS, VIEWS
from atrium.session import tune
from atrium.sources.fixtures import Tables


class Query(NamedTuple):
    run: Callable[[Tables], DataFrame]
    oracle: str | None


REGISTRY: dict[str, Query] = {}
NUDGE = {4: "2.3e-6", 6: "2.3e-8"}


def r(expr: str, digits: int = 6) -> str:
    """Oracle-side rounding, the counterpart of ``functions.vectors.r6``."""
    return f"round({expr} + {NUDGE[digits]}, {digits})"


def with_views(sql: str) -> str:
    """Prefix the derived tables a statement mentions (and those they need) as CTEs."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, ()):
            add(need)
        if name not in order:
            order.append(name)

    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            add(name)
    quoted = {name: re.sub(r"\bby\b", '"by"', VIEWS[name].strip()) for name in order}
    ctes = [f"{name} AS ({quoted[name]})" for name in order]
    sql = re.sub(r"\bby\b", '"by"', sql)  # the corner column, a keyword in DuckDB
    body = sql.strip()
    if re.match(r"with\b", body, re.I):
        head = re.sub(r"^with(\s+recursive)?\s+", "", body, flags=re.I)
        return "WITH RECURSIVE " + ",\n".join([*ctes, head])
    return ("WITH RECURSIVE " + ",\n".join(ctes) + "\n" if ctes else "") + body


def query(name: str, oracle: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(fn, with_views(oracle) if oracle else None)
        return fn

    return register


def spark_callable(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def call(spark: SparkSession, folder: str) -> DataFrame:
        return REGISTRY[name].run(Tables(tune(spark), folder))

    call.__name__ = name
    return call
