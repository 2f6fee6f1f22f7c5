"""Rows that can't be used, kept with the reason and where they came from instead of vanishing.

Rules say what is wrong with a row; the first that holds is the reason. What is good and what is in quarantine are filters
on one column, so that together they are the input.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.windows import last_instant
from tidemark.sources.inputs import as_day
from tidemark.sources.store import parse_narratives

REASON = "_reason"


def judged(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """rows with the first reason (a key of rules) whose condition holds, null where none does; a condition that is null doesn't hold."""
    reasons = [F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]
    return rows.withColumn(REASON, F.coalesce(*reasons) if reasons else F.lit(None).cast("string"))


def good(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col(REASON).isNull()).drop(REASON)


def quarantined(rows: DataFrame, source: str, *key: str) -> DataFrame:
    """(source, reason, key, raw): the rest, in the one form that all sources share: the key as text, and the whole row as JSON."""
    rest = rows.filter(F.col(REASON).isNotNull())
    own = [c for c in rows.columns if c != REASON]
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key])
    return rest.select(F.lit(source).alias("source"), F.col(REASON).alias("reason"), name.alias("key"), F.to_json(F.struct(*own)).alias("raw"))


def responses(rows: DataFrame, text: str = "response_text") -> DataFrame:
    """Stored responses with their parsed fields, judged: without text, without an object, or with one that lacks what an explanation needs."""
    blank = F.trim(F.coalesce(F.col(text), F.lit(""))) == ""
    out = parse_narratives(rows, text)
    return judged(out, {"empty response": blank, "no object": ~F.col("parse_ok"), "no summary": F.trim("summary") == ""})


def days(rows: DataFrame, column: str) -> DataFrame:
    """Rows with d, the day that a column holds in one of the known forms, judged: without one, or with one that can't be read."""
    out = rows.withColumn("d", as_day(rows, column))
    return judged(out, {"no day": F.trim(F.coalesce(F.col(column).cast("string"), F.lit(""))) == "", "unreadable day": F.col("d").isNull()})


def revisions(rows: DataFrame, time: str = "ts", boundary: str = "boundary") -> DataFrame:
    """Revisions of pages with their boundary, judged: without a time, or later than the end of the boundary's day."""
    return judged(rows, {"no time": F.col(time).isNull(), "no boundary": F.col(boundary).isNull(), "later than its boundary": F.col(time) > last_instant(F.col(boundary))})


def balance(rows: DataFrame, source: str) -> DataFrame:
    """(source, reason, n): how many rows are good (reason null) and how many are in quarantine for each reason."""
    return rows.groupBy(F.col(REASON).alias("reason")).agg(F.count("*").alias("n")).select(F.lit(source).alias("source"), "reason", "n")
