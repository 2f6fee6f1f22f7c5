"""Control days matched to transitions: near in time, but away from every transition and from each other."""

from __future__ import annotations

import bisect
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def control_candidates(transitions: DataFrame, states: DataFrame, window: int = 14, low: int = 30, high: int = 90, by: Sequence[str] = ("asset",), day: str = "d") -> DataFrame:
    """(*by, matched_to, d, offset_days): observed days from `low` to `high` days before or after a transition, and at least `window` days from all transitions."""
    if low <= window:
        raise ValueError("offsets must be larger than the window, or windows would share days")
    by = list(by)
    both = F.concat(F.sequence(F.lit(-high), F.lit(-low)), F.sequence(F.lit(low), F.lit(high)))
    offsets = transitions.select(*by, F.col(day).alias("matched_to"), F.explode(both).alias("offset_days")).distinct()
    out = offsets.withColumn(day, F.date_add("matched_to", F.col("offset_days"))).join(states.select(*by, day).distinct(), [*by, day], "left_semi")
    blocked = transitions.select(*by, F.explode(F.sequence(F.date_sub(day, window - 1), F.date_add(day, window - 1))).alias(day)).distinct()
    return out.join(blocked, [*by, day], "left_anti")


def nearest_transition(df: DataFrame, transitions: DataFrame, by: Sequence[str] = ("asset",), day: str = "d", name: str = "days_to_nearest") -> DataFrame:
    """df with the days to the nearest transition before or after, by carrying the last and the next one along one order: no pairing of all days."""
    by = list(by)
    keys = df.select(*by, day).distinct().withColumn("_t", F.lit(None).cast("date"))
    marks = transitions.select(*by, day).distinct().withColumn("_t", F.col(day))
    both = keys.unionByName(marks)
    w = Window.partitionBy(*by).orderBy(day)
    before = F.last("_t", True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    after = F.first("_t", True).over(w.rangeBetween(0, Window.unboundedFollowing))
    near = both.withColumn(name, F.least(F.datediff(day, before), F.datediff(after, day))).filter(F.col("_t").isNull()).drop("_t")
    return df.join(near, [*by, day], "left")


def stratum(state: str = "state", nearest: str = "days_to_nearest", least: int = 30) -> Column:
    """clean where the state is calm and no transition is within `least` days, else contaminated."""
    return F.when((F.col(state) == 0) & (F.col(nearest) >= least), "clean").otherwise("contaminated")


def sample_controls(candidates: DataFrame, per: int = 2, window: int = 14, gap: int = 20, seed: int = 7, by: Sequence[str] = ("asset",), day: str = "d") -> DataFrame:
    """At most `per` controls for each transition, taken in the order of the transitions and, within one, of a hash; each at least max(window, gap) days from all
    that were taken before. What is taken depends on all that came earlier, so each key's candidates (days, not rows) are gone through in one group."""
    apart = max(window, gap)
    key = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in by], F.col("matched_to").cast("string"), F.col(day).cast("string"))
    rows = candidates.withColumn("_h", F.sha2(key, 256))

    def take(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["matched_to", "_h"])
        taken, counts, keep = [], {}, []
        for m, d in zip(part["matched_to"], part[day]):
            at = bisect.bisect_left(taken, d)  # taken days are in order: only the next on either side can be too near
            fine = counts.get(m, 0) < per and all(abs((d - t).days) >= apart for t in taken[max(0, at - 1) : at + 1])
            keep.append(fine)
            if fine:
                taken.insert(at, d)
                counts[m] = counts.get(m, 0) + 1
        return part[keep].drop(columns="_h")

    return rows.groupBy(*by).applyInPandas(take, candidates.schema)


def bare_candidates(dates: DataFrame, universe: DataFrame | None = None, window: int = 14, low: int = 30, high: int = 90, by: Sequence[str] = ("asset",), day: str = "d") -> DataFrame:
    """Control candidates for dates that have no states behind them: days from `low` to `high` days before or after a date and at least `window` days
    from all of them; with a universe (*by, day) only those of its days. What sample_controls takes of them is matched as ever."""
    by = list(by)
    spread = dates.select(*by, F.explode(F.sequence(F.date_sub(day, high), F.date_add(day, high))).alias(day)).distinct()
    return control_candidates(dates, spread if universe is None else universe, window, low, high, by, day)


def matched_pairs(controls: DataFrame, transitions: DataFrame, by: Sequence[str] = ("asset",), day: str = "d") -> DataFrame:
    """(*by, d, n_controls, first_control, days_apart): each transition with how many controls are matched to it, the earliest, and how far the nearest is; transitions without one stay."""
    held = controls.groupBy(*by, F.col("matched_to").alias(day)).agg(F.count("*").alias("n_controls"), F.min(day).alias("first_control"), F.min(F.abs("offset_days")).alias("days_apart"))
    return transitions.select(*by, day).distinct().join(held, [*by, day], "left").na.fill(0, ["n_controls"])


def balance_report(controls: DataFrame, transitions: DataFrame, by: Sequence[str] = ("asset",), day: str = "d") -> DataFrame:
    """Per key: numbers, mean years and their gap, mean distance, share of clean ones, and transitions without a control. controls has stratum and offset_days."""
    by = list(by)
    c = controls.groupBy(*by).agg(
        F.count("*").alias("n_controls"), F.avg(F.year(day)).alias("mean_year_controls"), F.avg(F.abs("offset_days")).alias("mean_abs_offset"), F.min(F.abs("offset_days")).alias("min_abs_offset"), F.count_if(F.col("stratum") == "clean").alias("n_clean")
    )
    t = transitions.groupBy(*by).agg(F.count("*").alias("n_transitions"), F.avg(F.year(day)).alias("mean_year_transitions"))
    bare = transitions.select(*by, F.col(day).alias("matched_to")).join(controls.select(*by, "matched_to").distinct(), [*by, "matched_to"], "left_anti").groupBy(*by).agg(F.count("*").alias("n_uncovered"))
    out = t.join(c, by, "left").join(bare, by, "left").na.fill(0, ["n_controls", "n_clean", "n_uncovered"])
    return out.withColumn("year_gap", F.col("mean_year_controls") - F.col("mean_year_transitions"))
