"""Registry of checked queries: a Spark callable and, where SQL can say it, the SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workload.binding import Tables
from workload.oracles import DIGITS, build

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, extra: dict[str, str] | None = None):
    """Registers a function of the bound tables under `name`."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(Tables(spark, sf_dir)))
        if sql is not None:
            ORACLES[name] = build(sql, extra)
        return fn

    return wrap


def rounded(df: DataFrame) -> DataFrame:
    """Doubles at DIGITS decimals, so that summation order cannot show."""
    return df.select(*[
        F.round(F.col(f"`{n}`"), DIGITS).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes
    ])
