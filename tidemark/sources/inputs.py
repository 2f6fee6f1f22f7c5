"""Uploaded tables: which column holds the days, and which the states."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY_NAMES = ("date", "day", "timestamp", "datetime", "transition_date", "transition", "d")
STATE_NAMES = ("state", "regime", "label", "cluster")


@dataclass(frozen=True)
class Columns:
    """What was found: names of the day and state columns, and the share of rows of each column that are days."""

    day: str | None
    state: str | None
    shares: dict[str, float]


def as_day(df: DataFrame, c: str):
    """The day that a column holds, in one of the forms known; null where it can't be read or lies outside 1900 to 2100."""
    kind = df.schema[c].dataType
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.to_date(F.col(c))
    day = F.coalesce(*[F.try_to_date(F.col(c).cast("string"), f) for f in ("yyyy-MM-dd", "yyyy/MM/dd", "M/d/yyyy", "d MMM yyyy", "d MMMM yyyy", "yyyyMMdd")], F.to_date(F.try_to_timestamp(F.col(c).cast("string"))))
    return F.when(F.year(day).between(1900, 2100), day)


def infer_columns(df: DataFrame, least: float = 0.6) -> Columns:
    """One aggregate over the table: the day column is one of a known name, else the one with most days (not a numeric one), of equal ones the first, if it has `least` of them."""
    candidates = [c for c in df.columns if not isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType, T.ArrayType, T.MapType, T.StructType))]
    row = df.agg(F.count("*").alias("_n"), *[F.count(as_day(df, c)).alias(f"_{i}") for i, c in enumerate(candidates)]).first()
    shares = {c: (row[f"_{i}"] / row["_n"] if row["_n"] else 0.0) for i, c in enumerate(candidates)}
    named = [c for c in candidates if c.lower() in DAY_NAMES and shares[c] >= least]
    best = max(candidates, key=lambda c: shares[c], default=None)
    day = named[0] if named else best if best is not None and shares[best] >= least else None
    state = next((c for c in df.columns if c.lower() in STATE_NAMES and c != day), None)
    return Columns(day, state, shares)


def days_and_states(df: DataFrame, least: float = 0.6) -> DataFrame:
    """(d[, state]): distinct days in no order; rows whose day can't be read go. Of a day with several states the least is taken."""
    found = infer_columns(df, least)
    if found.day is None:
        raise ValueError(f"no column holds days in {least:.0%} of its rows: {found.shares}")
    rows = df.select(as_day(df, found.day).alias("d"), *([F.expr(f"try_cast(`{found.state}` AS INT)").alias("state")] if found.state else [])).filter("d IS NOT NULL")
    return rows.groupBy("d").agg(F.min("state").alias("state")) if found.state else rows.distinct()


def pasted_days(spark: SparkSession, text: str) -> DataFrame:
    """(d): the distinct days of a pasted list, parted by commas, semicolons, tabs or line feeds; what can't be read as a day goes."""
    parts = spark.createDataFrame([(text,)], "_all string").select(F.explode(F.split("_all", "[,;\t\n]+")).alias("_raw"))
    raw = parts.select(F.trim("_raw").alias("_raw"))
    return raw.select(as_day(raw, "_raw").alias("d")).filter("d IS NOT NULL").distinct()
