"""All registered queries: name -> (Spark callable, SQL text or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barloom.functions.algebra import Factor
from barloom.operators.evaluate import evaluate
from checks.panels import bars, bars_sql, dealt, panel_sizes, present, present_sql
from checks.sqltext import factor_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, run: Query, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} registered twice")
    QUERIES[name] = run
    if sql is not None:
        SQL[name] = sql


def add_factors(name: str, factors: dict[str, Factor], unit: str = "day") -> None:
    """A query evaluating factors on the whole bar panel, with generated SQL beside it."""
    cols = list(factors)

    def run(spark: SparkSession, sf: str) -> DataFrame:
        parts, whole = dealt(spark, sf)
        out = evaluate(bars(spark, sf, unit), factors, keep=[], sizes=panel_sizes(spark, sf, unit), parts=parts if whole else 0)
        return present(out, ["vt_symbol", "datetime"], (), cols)

    ctes, last = factor_sql("bars", factors, ["vt_symbol", "datetime"])
    add(name, run, f"WITH {bars_sql(unit)}, {ctes} " + present_sql(last, ["vt_symbol", "datetime"], (), cols))
