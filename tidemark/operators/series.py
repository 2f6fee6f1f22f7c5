"""Operators on series: one row per key and day, in window functions over each key.

Every function takes the names of the key columns (`by`) and of the order column, so that many series are worked on in
parallel; none orders the whole table. NaN counts as null.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRADING_DAYS = 252


def clean(col: str) -> Column:
    """The column with NaN as null."""
    return F.nanvl(F.col(col).cast("double"), F.lit(None).cast("double"))


def over(by: Sequence[str], order: str = "d"):
    return Window.partitionBy(*by).orderBy(order)


def simple_return(df: DataFrame, price: str = "px", by: Sequence[str] = ("asset",), order: str = "d", lag: int = 1, name: str = "ret") -> DataFrame:
    """x / x `lag` rows before - 1; null for the first rows and after a zero."""
    before = F.lag(price, lag).over(over(by, order))
    return df.withColumn(name, F.col(price) / F.when(before != 0, before) - 1)


def rolling_std(df: DataFrame, value: str, rows: int, first: int, last: int, name: str, by: Sequence[str] = ("asset",), order: str = "d") -> DataFrame:
    """Sample standard deviation of the rows from `first` to `last` around each row; null unless all `rows` values are there."""
    frame = over(by, order).rowsBetween(first, last)
    return df.withColumn(name, F.when(F.count(value).over(frame) == rows, F.stddev_samp(value).over(frame)))


def trailing_vol(df: DataFrame, value: str = "ret", rows: int = 20, name: str = "vol", **keys) -> DataFrame:
    return rolling_std(df, value, rows, -(rows - 1), 0, name, **keys)


def forward_vol(df: DataFrame, value: str = "ret", rows: int = 20, name: str = "fvol", **keys) -> DataFrame:
    """Volatility of the `rows` rows that follow: nothing of the row itself enters."""
    return rolling_std(df, value, rows, 1, rows, name, **keys)


def intersect_calendars(frames: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """The rows whose keys are in all frames, with the columns of all."""
    return reduce(lambda a, b: a.join(b, list(on)), frames)


def assemble_features(prices: DataFrame, level: DataFrame, credit: DataFrame, on: Sequence[str] = ("asset", "d"), lookback: int = 20) -> DataFrame:
    """vol, mom, level and credit return on the days that all three have; returns are taken on those days, and rows that lack a feature go.

    prices: (*on, px); level: (*on, level); credit: (*on, credit)."""
    by, order = list(on[:-1]), on[-1]
    days = intersect_calendars([prices, level, credit], on)
    days = simple_return(days, "px", by, order, 1, "_ret")
    days = trailing_vol(days, "_ret", lookback, "vol", by=by, order=order)
    days = simple_return(days, "px", by, order, lookback, "mom")
    days = simple_return(days, "credit", by, order, lookback, "credit_ret")
    return days.drop("_ret").na.drop(subset=["vol", "mom", "level", "credit_ret"])


def forward_fill(df: DataFrame, value: str, by: Sequence[str] = ("asset",), order: str = "d", name: str | None = None) -> DataFrame:
    """The last value that isn't null, up to each row."""
    frame = over(by, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name or value, F.last(value, ignorenulls=True).over(frame))


def onto_days(days: DataFrame, values: DataFrame, value: str, on: Sequence[str] = ("asset", "d"), fill: bool = False) -> DataFrame:
    """days with the values of their day, or (fill) of the last day before it in days that has one."""
    out = days.join(values.select(*on, value), list(on), "left")
    return forward_fill(out, value, on[:-1], on[-1]) if fill else out


def changes(df: DataFrame, state: str = "state", by: Sequence[str] = ("asset",), order: str = "d", name: str = "changed") -> DataFrame:
    """Whether the state differs from the row before; false on the first row."""
    return df.withColumn(name, F.coalesce(F.col(state) != F.lag(state).over(over(by, order)), F.lit(False)))


def run_ids(df: DataFrame, state: str = "state", by: Sequence[str] = ("asset",), order: str = "d", name: str = "run") -> DataFrame:
    """A number for each run of equal states, from 0."""
    flagged = changes(df, state, by, order, "_changed")
    return flagged.withColumn(name, F.sum(F.col("_changed").cast("int")).over(over(by, order))).drop("_changed")


def episodes(df: DataFrame, state: str = "state", by: Sequence[str] = ("asset",), order: str = "d") -> DataFrame:
    """(*by, run, state, start, end, length): one row for each run."""
    runs = run_ids(df, state, by, order)
    return runs.groupBy(*by, "run").agg(F.first(state).alias("state"), F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("length"))


def shading_spans(df: DataFrame, state: str = "state", by: Sequence[str] = ("asset",), order: str = "d") -> DataFrame:
    """Runs from their start to the start of the next (the last: to its end)."""
    runs = episodes(df, state, by, order)
    return runs.withColumn("until", F.coalesce(F.lead("start").over(over(by, "run")), F.col("end")))


def flip_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ("asset",), order: str = "d") -> DataFrame:
    """How often each of the columns changes."""
    for c in columns:
        df = changes(df, c, by, order, f"_{c}")
    return df.groupBy(*by).agg(*[F.count_if(f"_{c}").alias(f"{c}_flips") for c in columns])


def number_rows(df: DataFrame, by: Sequence[str] = ("asset",), order: str = "d", name: str = "i") -> DataFrame:
    """Row numbers from 0 in each series."""
    return df.withColumn(name, F.row_number().over(over(by, order)) - 1)


def folds(df: DataFrame, train: int, test: int, by: Sequence[str] = ("asset",), i: str = "i") -> DataFrame:
    """(*by, fold, train_start, test_start, test_end): folds whose test ranges follow each other, as far as rows last."""
    if train < 1 or test < 1:
        raise ValueError("train and test must be positive")
    sizes = df.groupBy(*by).agg((F.max(i) + 1).alias("n"))
    last = F.floor((F.col("n") - train - test) / test)
    each = sizes.filter(F.col("n") >= train + test).select(*by, F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("fold"))
    start = F.col("fold") * test
    return each.withColumns({"train_start": start, "test_start": start + train, "test_end": start + train + test})


def fan_out(df: DataFrame, train: int, test: int, by: Sequence[str] = ("asset",), i: str = "i") -> DataFrame:
    """Each row once for each fold that it is in, with `part` train or test. The fold numbers follow from the row number, so that this is
    a join on equal keys of as many rows as come out, never a range join."""
    span = train + test
    low = F.greatest(F.lit(0), F.ceil((F.col(i) - (span - 1)) / test)).cast("int")
    high = F.floor(F.col(i) / test).cast("int")
    rows = df.withColumn("fold", F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))))
    rows = rows.join(folds(df, train, test, by, i), [*by, "fold"])
    return rows.withColumn("part", F.when(F.col(i) < F.col("test_start"), "train").otherwise("test"))


def scaler_params(rows: DataFrame, features: Sequence[str], by: Sequence[str] = ("asset", "fold")) -> DataFrame:
    """Mean and population standard deviation of each feature over the training rows."""
    train = rows.filter(F.col("part") == "train")
    return train.groupBy(*by).agg(*[f(c).alias(f"{c}_{n}") for c in features for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))])


def standardise(rows: DataFrame, features: Sequence[str], by: Sequence[str] = ("asset", "fold")) -> DataFrame:
    """Training and test rows scaled by what the training rows show; a constant feature is only centred."""
    out = rows.join(scaler_params(rows, features, by), list(by))
    for c in features:
        std = F.col(f"{c}_std")
        out = out.withColumn(c, (F.col(c) - F.col(f"{c}_mean")) / F.when(std > 0, std).otherwise(1.0))
    return out.drop(*[f"{c}_{n}" for c in features for n in ("mean", "std")])
