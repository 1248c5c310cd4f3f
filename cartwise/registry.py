"""Registry of named queries, each with its output columns and, where SQL can say it, its SQL.

Column kinds: ``i`` integer, ``n`` integer or NULL (shown as a double, as data frames do), ``d``
double (rounded), ``s`` text, ``a`` array shown as text. The same declaration shapes the Spark
result and the SQL result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwise.oracle import with_views

Build = Callable[[SparkSession, str], DataFrame]
DIGITS = 6


@dataclass(frozen=True)
class Entry:
    """``plan`` gives the frame itself, ``build`` the frame in the declared, comparable shape."""

    plan: Build
    build: Build
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def _columns(spec: str) -> list[tuple[str, str]]:
    """``"user_id:i rate:d"`` → [(user_id, i), (rate, d)]; ``a,b:i`` shares one kind."""
    out = []
    for item in spec.split():
        names, kind = item.split(":")
        out += [(name, kind) for name in names.split(",")]
    return out


def _spark_column(name: str, kind: str) -> Column:
    c = F.col(name)
    shaped = {
        "i": lambda: c.cast("bigint"),
        "n": lambda: c.cast("double"),
        "d": lambda: F.round(c.cast("double"), DIGITS),
        "s": lambda: c.cast("string"),
        "a": lambda: F.array_join(c.cast("array<string>"), ","),
    }[kind]()
    return shaped.alias(name)


def _sql_column(name: str, kind: str) -> str:
    q = f'"{name}"'
    return {
        "i": f"CAST({q} AS BIGINT) AS {q}",
        "n": f"CAST({q} AS DOUBLE) AS {q}",
        "d": f"round(CAST({q} AS DOUBLE), {DIGITS}) AS {q}",
        "s": f"CAST({q} AS VARCHAR) AS {q}",
        "a": f"array_to_string({q}, ',') AS {q}",
    }[kind]


def query(name: str, spec: str, sql: str | None = None) -> Callable[[Build], Build]:
    columns = _columns(spec)

    def add(build: Build) -> Build:
        def shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(spark, sf_dir).select(*[_spark_column(n, k) for n, k in columns])

        text = None
        if sql is not None:
            picked = ", ".join(_sql_column(n, k) for n, k in columns)
            text = with_views(sql, picked)
        if name in ENTRIES:
            raise ValueError(f"query {name} is registered twice")
        ENTRIES[name] = Entry(build, shaped, text)
        return build

    return add
