"""Whether regimes found one way hold for series that played no part in choosing it: one row of measures for each asset.

Every asset is met with the same level and credit series on its own calendar, walks forward by itself, and is measured
by the volatility of what follows. An asset that can't be measured is a row with the reason, and hurts no other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import hmm, separation, series

MEASURES = ["n_folds", "vol_calm", "vol_stressed", "ratio_oos", "ratio_low", "ratio_high", "ratio_forward", "per_fold_median", "levene_p", "n_calm", "n_stressed"]


def features(prices: DataFrame, shared: DataFrame) -> DataFrame:
    """(asset, d, ret, mom, vol, fvol, level, credit): features of each asset (asset, d, px), and the shared series (d, level, credit; credit as a return) on those of its days that they have."""
    own = series.forward_vol(series.trailing_vol(series.simple_return(series.simple_return(prices), lag=20, name="mom")))
    credit = series.simple_return(shared.withColumn("_one", F.lit(1)), "credit", by=["_one"], name="credit_ret").select("d", "level", F.col("credit_ret").alias("credit"))
    return own.join(credit, "d")


def generalisation(
    prices: DataFrame, shared: DataFrame, keep: Callable[[DataFrame], DataFrame], train: int = 756, test: int = 126, seed: int = 42, rounds: int = 200,
    columns: Sequence[str] = ("vol", "mom", "level", "credit"), level: str = "vol", draws: int = 2000,
) -> DataFrame:
    """(asset, n_days, *MEASURES, error): one row for each asset of prices, with the measures of its out-of-sample states, or with null measures and the error: too
    few days for one fold, or no fold that could be fitted. keep writes a DataFrame and gives it back (the walk is used several times)."""
    rows = keep(features(prices, shared).na.drop(subset=list(columns)))
    walk = keep(hmm.walk_forward(rows, list(columns), level, train, test, [seed], rounds=rounds))
    told = walk.filter("d IS NOT NULL").select("asset", "fold", "d", "state").join(rows.select("asset", "d", "ret", "fvol"), ["asset", "d"])
    apart = separation.with_p_values(separation.vol_separation(told))
    interval = separation.quantile_interval(separation.block_bootstrap(told, draws=draws), "ratio", ["asset"])
    folds = separation.fold_summary(separation.per_fold_ratios(told))
    days = prices.select("asset").distinct().join(rows.groupBy("asset").agg(F.count("*").alias("n_days")), "asset", "left").na.fill(0, ["n_days"])
    failed = walk.groupBy("asset").agg(F.count_distinct(F.when(F.col("d").isNotNull(), F.col("fold"))).alias("n_folds"), F.max("error").alias("_why"))
    out = days.join(failed, "asset", "left")
    out = out.join(apart.select("asset", F.col("vol0").alias("vol_calm"), F.col("vol1").alias("vol_stressed"), F.col("ratio").alias("ratio_oos"), "levene_p", F.col("n0").alias("n_calm"), F.col("n1").alias("n_stressed")), "asset", "left")
    out = out.join(interval.select("asset", F.col("low").alias("ratio_low"), F.col("high").alias("ratio_high")), "asset", "left")
    out = out.join(separation.forward_separation(told).select("asset", F.col("mean_ratio").alias("ratio_forward")), "asset", "left")
    out = out.join(folds.select("asset", F.col("median_ratio").alias("per_fold_median")), "asset", "left")
    few = F.format_string(f"ValueError: {train + test} days are needed, there are %d", F.col("n_days"))
    error = F.when(F.col("n_days") < train + test, few).when(F.coalesce("n_folds", F.lit(0)) == 0, F.coalesce("_why", F.lit("ValueError: no fold")))
    return out.withColumn("error", error).select("asset", "n_days", *[F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in MEASURES], "error")


def summary(rows: DataFrame) -> DataFrame:
    """One row over all assets: how many were measured and failed, in how many the ratio and its lower bound exceed one, and the median ratio."""
    return rows.agg(
        F.count_if(F.col("error").isNull()).alias("n_assets"), F.count("error").alias("n_failed"), F.count_if(F.col("ratio_oos") > 1).alias("n_above_one"),
        F.count_if(F.col("ratio_low") > 1).alias("n_surely_above_one"), F.median("ratio_oos").alias("median_ratio"),
    )
