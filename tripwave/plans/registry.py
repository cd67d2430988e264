"""Registered queries: name, Spark function, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def add(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, folder)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = expand(sql)
        return fn

    return add


# Added before rounding on both sides: moves exact ties and negative zero off the rounding edge.
OFF_TIE = 1.234567e-9


def r6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + OFF_TIE, 6)


def expand(sql: str) -> str:
    """Write out ``r6(x)`` in SQL text as the rounding above."""
    while "r6(" in sql:
        head, rest = sql.split("r6(", 1)
        depth = 1
        for end, ch in enumerate(rest):
            depth += {"(": 1, ")": -1}.get(ch, 0)
            if depth == 0:
                break
        sql = f"{head}round({rest[:end]} + {OFF_TIE}, 6){rest[end + 1:]}"
    return sql


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    """Floats to six places, so that summation order does not show."""
    return df.withColumns({c: r6(c) for c in cols})
