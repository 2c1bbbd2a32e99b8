"""Registry: one column list serves the Spark result and the SQL result.

A column list names the result columns; a suffix gives the kind: ``:i`` integer,
``:d`` double rounded to six places, ``:f`` to three (sums and deviations,
whose last digits depend on the order of summation), ``:t`` timestamp as text, ``:b`` boolean as
0/1. Doubles are nudged by far less than the rounding unit first, so that exact
decimal halves round the same way in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NUDGE = 3.3e-9
PLACES = {"d": 6, "f": 3}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
CTES: dict[str, str] = {}


def _parts(cols: str):
    for c in cols.split():
        name, _, kind = c.partition(":")
        yield name, kind


def spark_select(df: DataFrame, cols: str) -> DataFrame:
    out = []
    for name, kind in _parts(cols):
        c = F.col(name)
        if kind == "i":
            c = c.cast("long")
        elif kind == "b":
            c = c.cast("int").cast("long")
        elif kind in PLACES:
            c = F.round(c.cast("double") + NUDGE, PLACES[kind]) + 0.0
        elif kind == "t":
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        out.append(c.alias(name))
    return df.select(*out)


def sql_select(cols: str) -> str:
    out = []
    for name, kind in _parts(cols):
        if kind in ("i", "b"):
            out.append(f"CAST({name} AS BIGINT) AS {name}")
        elif kind in PLACES:
            out.append(f"round(CAST({name} AS DOUBLE) + {NUDGE}, {PLACES[kind]}) + 0.0 AS {name}")
        elif kind == "t":
            out.append(f"strftime({name}, '%Y-%m-%d %H:%M:%S') AS {name}")
        else:
            out.append(name)
    return ", ".join(out)


def cte(name: str, text: str) -> None:
    CTES[name] = text


def with_ctes(used: str, body: str) -> str:
    """The listed common table expressions in order, then the statement."""
    order: list[str] = []

    def add(n: str) -> None:
        for part in n.split(">"):
            if part not in order:
                order.append(part)

    for n in used.split():
        for d in DEPENDS.get(n, "").split():
            add(d)
        add(n)
    heads = ",\n".join(f"{n} AS (\n{CTES[n]}\n)" for n in order)
    return f"WITH {heads}\n{body}" if heads else body


DEPENDS: dict[str, str] = {}


def query(cols: str, sql: str | None = None, ctes: str = "", name: str | None = None):
    """Register a query. ``sql`` is what follows ``SELECT <cols> FROM``."""

    def wrap(fn):
        key = name or fn.__name__
        assert key not in QUERIES, key
        QUERIES[key] = lambda spark, sf_dir: spark_select(fn(spark, sf_dir), cols)
        if sql is not None:
            ORACLE[key] = with_ctes(ctes, f"SELECT {sql_select(cols)} FROM {sql}")
        return fn

    return wrap
