"""Catalogue of runnable queries, each with an equivalent SQL text where SQL can say it.

A query gives its result columns with a kind (``name:kind``); the same shaping is applied
to the Spark result and to the SQL text, so names, types and rounding agree.

kinds: s text, i bigint, f double to 4 places, d date text, t timestamp text, b 0/1
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.session import bound_tasks

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, tuple[str, str]] = {}
VIEWS: dict[str, str] = {}


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(item.rsplit(":", 1)) for item in spec.split()]


def _shape_column(name: str, kind: str) -> Column:
    col = F.col(f"`{name}`")
    if kind == "i":
        col = col.cast("bigint")
    elif kind == "b":
        col = col.cast("int").cast("bigint")
    elif kind == "f":
        # the nudge keeps exact ties away from the rounding edge, + 0.0 drops a minus zero
        col = F.round(col.cast("double") + 1e-9, 4) + 0.0
    elif kind == "d":
        col = F.date_format(col, "yyyy-MM-dd")
    elif kind == "t":
        col = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
    else:
        col = col.cast("string")
    return col.alias(name)


def _shape_sql(name: str, kind: str) -> str:
    quoted = f'"{name}"'
    if kind in ("i", "b"):
        expression = f"CAST({quoted} AS BIGINT)"
    elif kind == "f":
        expression = f"round(CAST({quoted} AS DOUBLE) + 1e-9, 4) + 0.0"
    elif kind == "d":
        expression = f"strftime(CAST({quoted} AS DATE), '%Y-%m-%d')"
    elif kind == "t":
        expression = f"strftime(CAST({quoted} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')"
    else:
        expression = f"CAST({quoted} AS VARCHAR)"
    return f"{expression} AS {quoted}"


def view(name: str, sql: str) -> None:
    """A named SQL view that query texts may use."""
    VIEWS[name] = sql.strip()


def _with_views(body: str) -> str:
    """WITH entries for every view the text names, dependencies first."""
    ordered: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in seen and re.search(rf"\b{name}\b", text):
                seen.add(name)
                visit(VIEWS[name])
                ordered.append(name)

    visit(body)
    return ",\n".join(f"{name} AS ({VIEWS[name]})" for name in ordered)


def oracle_texts() -> dict[str, str]:
    """The full SQL text of every query that has one."""
    texts = {}
    for name, (spec, body) in ORACLES.items():
        shaped = ", ".join(_shape_sql(n, k) for n, k in _columns(spec))
        ctes = _with_views(body)
        lead = f"{ctes},\n" if ctes else ""
        texts[name] = f"WITH {lead}result_rows AS ({body.strip()})\nSELECT {shaped} FROM result_rows"
    return texts


def query(name: str, spec: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``."""
    columns = _columns(spec)

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            bound_tasks(spark, sf_dir)
            return fn(spark, sf_dir).select(*[_shape_column(n, k) for n, k in columns])

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = (spec, sql)
        return fn

    return register


def mode_sql(table: str, keys: str, column: str, where: str = "") -> str:
    """SQL for the most frequent non-null value of each key, smallest among ties."""
    condition = f" AND {where}" if where else ""
    return (
        f"SELECT {keys}, {column} FROM (SELECT {keys}, {column}, row_number() OVER "
        f"(PARTITION BY {keys} ORDER BY count(*) DESC, {column}) AS pos FROM {table} "
        f"WHERE {column} IS NOT NULL{condition} GROUP BY {keys}, {column}) WHERE pos = 1"
    )
