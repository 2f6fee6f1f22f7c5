"""From states to transitions that persist and that several seeds agree on."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.series import changes, episodes, over, run_ids


def merge_short_runs(states: list[int], lengths: list[int], least: int) -> list[int]:
    """New states of runs: the shortest run below `least` (of equal ones the first) takes the state of its longer neighbour (of equal ones the one
    before) and joins the runs around it that now have its state, until no run is too short or one is left. A heap gives the shortest, and
    neighbours are linked, so that all merges take n log n steps."""
    n = len(states)
    state, size = list(states), list(lengths)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    head = list(range(n))  # of a run that has joined another, the run that it joined

    def join(left: int, right: int) -> None:
        """right becomes part of left, which stands before it."""
        size[left] += size[right]
        head[right] = left
        after[left] = after[right]
        if after[right] >= 0:
            before[after[right]] = left

    # Runs of one state side by side are one run.
    for k in range(1, n):
        if state[before[k]] == state[k]:
            join(before[k], k)
    heap = [(size[k], k) for k in range(n) if head[k] == k]
    heapq.heapify(heap)
    while heap:
        length, k = heapq.heappop(heap)
        if head[k] != k or size[k] != length:
            continue
        if length >= least or (before[k] < 0 and after[k] < 0):
            break
        i, j = before[k], after[k]
        state[k] = state[j if i < 0 or (j >= 0 and size[j] > size[i]) else i]
        if j >= 0 and state[j] == state[k]:
            join(k, j)
        if i >= 0 and state[i] == state[k]:
            join(i, k)
            k = i
        heapq.heappush(heap, (size[k], k))
    out = []
    for k in range(n):
        while head[k] != head[head[k]]:
            head[k] = head[head[k]]
        out.append(state[head[k]])
    return out


def _filtered_runs(rows: DataFrame, leasts: Sequence[int], state: str, by: Sequence[str]) -> DataFrame:
    """(*by, _run, _least, _new): the runs of rows (with _run) after those shorter than each of `leasts` are absorbed."""
    runs = rows.groupBy(*by, "_run").agg(F.first(state).cast("int").alias("_state"), F.count("*").alias("_n"))
    runs = runs.withColumn("_least", F.explode(F.array(*[F.lit(int(n)) for n in leasts])))

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_run")
        part["_new"] = merge_short_runs(part["_state"].tolist(), part["_n"].tolist(), int(part["_least"].iloc[0]))
        return part[[*by, "_run", "_least", "_new"]]

    keys = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)
    return runs.groupBy(*by, "_least").applyInPandas(merge, f"{keys}, _run long, _least int, _new int")


def persistence_filter(df: DataFrame, least: int, state: str = "state", by: Sequence[str] = ("asset",), order: str = "d", name: str = "filtered") -> DataFrame:
    """df with the states that are left when runs shorter than `least` rows are absorbed. Each merge changes the next choice, so a series' runs (not its rows)
    are gathered, and runs are numbered and joined back in Spark. least <= 1 changes nothing."""
    if least <= 1:
        return df.withColumn(name, F.col(state))
    rows = run_ids(df, state, by, order, "_run")
    new = _filtered_runs(rows, [least], state, by).drop("_least")
    return rows.join(new, [*by, "_run"]).withColumn(name, F.col("_new").cast(df.schema[state].dataType)).drop("_run", "_new")


def extract_transitions(df: DataFrame, state: str = "filtered", by: Sequence[str] = ("asset",), order: str = "d", fold: str | None = None, prob: str | None = None, at_fold_starts: bool = False) -> DataFrame:
    """(*by, d, from_state, to_state, direction, dwell_before, dwell_after[, fold, prob]): the starts of runs but the first. Those on the first day of a fold other than the series'
    first one are left out unless at_fold_starts: there the model changes, not the market."""
    runs = episodes(df, state, by, order)
    w = over(by, "run")
    out = runs.withColumns({"from_state": F.lag("state").over(w), "dwell_before": F.lag("length").over(w)}).filter(F.col("from_state").isNotNull())
    out = out.select(*by, F.col("start").alias(order), "from_state", F.col("state").alias("to_state"), F.when(F.col("state") == 1, "calm->stressed").otherwise("stressed->calm").alias("direction"), "dwell_before", F.col("length").alias("dwell_after"))
    extra = [c for c in (fold, prob) if c]
    if extra:
        out = out.join(df.select(*by, order, *extra), [*by, order], "left")
    if fold:
        firsts = df.groupBy(*by, fold).agg(F.min(order).alias(order)).select(*by, order, F.lit(True).alias("at_fold_start"))
        out = out.join(firsts, [*by, order], "left").withColumn("at_fold_start", F.coalesce("at_fold_start", F.lit(False)))
        if not at_fold_starts:
            out = out.filter(~F.col("at_fold_start"))
    return out


def dwell_sensitivity(df: DataFrame, thresholds: Sequence[int], state: str = "state", by: Sequence[str] = ("asset",), order: str = "d") -> DataFrame:
    """For each threshold: transitions by direction, and the lengths of episodes. The threshold is a key, so that the series is read once for all."""
    rows = run_ids(df, state, by, order, "_run")
    new = _filtered_runs(rows, thresholds, state, by).withColumnRenamed("_least", "min_dwell")
    kept = rows.select(*by, order, "_run").join(new, [*by, "_run"]).withColumn("filtered", F.col("_new").cast(df.schema[state].dataType))
    keys = [*by, "min_dwell"]
    runs = episodes(kept, "filtered", keys, order).withColumn("_from", F.lag("state").over(over(keys, "run")))
    came = F.col("_from").isNotNull()
    return runs.groupBy(*keys).agg(
        F.count_if(came).alias("n_transitions"),
        F.count_if(came & (F.col("state") == 1)).alias("n_to_stressed"),
        F.count_if(came & (F.col("state") == 0)).alias("n_to_calm"),
        F.median("length").alias("median_dwell"), F.avg("length").alias("mean_dwell"), F.max("length").alias("max_dwell"),
    )


def multi_state_changes(df: DataFrame, least: int, state: str = "state", by: Sequence[str] = ("asset",), order: str = "d") -> DataFrame:
    """Days on which a run of at least `least` rows begins after another state. Any number of labels, nothing is absorbed."""
    rows = run_ids(changes(df, state, by, order), state, by, order, "_run")
    size = F.count("*").over(Window.partitionBy(*by, "_run"))
    return rows.withColumn("run_length", size).filter(F.col("changed") & (F.col("run_length") >= least)).select(*by, order, state, "run_length")


def leader_clusters(df: DataFrame, tolerance: int, by: Sequence[str] = ("asset", "to_state"), order: str = "d") -> DataFrame:
    """df with `leader`: the first day, then each first day more than `tolerance` days after the leader before it. Days are not chained: a cluster spans
    `tolerance` days at most. Works on the distinct days of each key."""
    days = df.select(*by, order).distinct()

    def lead(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        leaders, last = [], None
        for d in part[order]:
            if last is None or (d - last).days > tolerance:
                last = d
            leaders.append(last)
        part["leader"] = leaders
        return part

    keys = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    led = days.groupBy(*by).applyInPandas(lead, f"{keys}, `{order}` date, leader date")
    return df.join(led, [*by, order])


def stable_transitions(df: DataFrame, tolerance: int = 5, support: float = 0.6, by: Sequence[str] = ("asset",), order: str = "d", seed: str = "seed", n_seeds: int | None = None) -> DataFrame:
    """(*by, d, to_state, support, n_members, dwell_after): clusters of transitions to one state that at least a share `support` of the seeds have. The day is the upper
    median of the members' days, the dwell the whole part of their median."""
    seeds = df.groupBy(*by).agg(F.count_distinct(seed).alias("_seeds")) if n_seeds is None else df.select(*by).distinct().withColumn("_seeds", F.lit(n_seeds))
    led = leader_clusters(df, tolerance, [*by, "to_state"], order)
    days = F.array_sort(F.collect_list(order))
    out = led.groupBy(*by, "to_state", "leader").agg(days.alias("_days"), F.count_distinct(seed).alias("_have"), F.count("*").alias("n_members"), F.median("dwell_after").cast("int").alias("dwell_after"))
    out = out.join(seeds, list(by)).withColumn("support", F.col("_have") / F.col("_seeds")).filter(F.col("support") >= support)
    middle = F.element_at("_days", (F.floor(F.size("_days") / 2) + 1).cast("int"))
    return out.select(*by, middle.alias(order), "to_state", "support", "n_members", "dwell_after")


def log_histogram(runs: DataFrame, bins: int = 17, length: str = "length", by: Sequence[str] = ("asset", "state")) -> DataFrame:
    """(*by, bin, low, high, n): how many lengths fall in each of `bins` bins that are equal in the logarithm, from each key's least length (at least 1) to its
    greatest (at least 2). The last bin holds its upper end; bins without a length are kept, with 0. Lengths that are null or below 1 don't count."""
    if bins < 1:
        raise ValueError("a histogram has one bin at least")
    rows = runs.filter(F.col(length) >= 1).select(*by, F.col(length).cast("double").alias("_x"))
    ends = rows.groupBy(*by).agg(F.min("_x").alias("_low"), F.greatest(F.max("_x"), F.lit(2.0)).alias("_high"))
    wide = F.log(F.col("_high") / F.col("_low"))
    # One bin where all lengths are equal (and above 2): it holds them all.
    place = F.when(wide > 0, F.least(F.floor(bins * F.log(F.col("_x") / F.col("_low")) / wide + 1e-9), F.lit(bins - 1))).otherwise(F.lit(bins - 1))
    counts = rows.join(ends, list(by)).groupBy(*by, place.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    edge = lambda k: F.col("_low") * F.exp(wide * k / bins)
    out = every.join(counts, [*by, "bin"], "left")
    return out.select(*by, "bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))
