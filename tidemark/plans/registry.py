"""The register of queries: a function of (spark, sf_dir) with, where there is one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def places(*names: str, n: int = 6) -> list[Column]:
    """The columns rounded to n places; -0.0 becomes 0.0."""
    return [(F.round(c, n) + F.lit(0.0)).alias(c) for c in names]


def text_days(*names: str) -> list[Column]:
    return [F.date_format(c, "yyyy-MM-dd").alias(c) for c in names]
