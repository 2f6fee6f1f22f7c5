"""Exact and interval inference on small tables of counts, as DataFrames: each row of the input is one table.

Probabilities of counts go through log factorials in closed form, so that everything stays in column expressions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import normal
from tidemark.functions.tails import beta_inc
from tidemark.operators.separation import draw

Z_975 = 1.959963984540054


_SMALL = [math.lgamma(i + 1) for i in range(16)]


def log_factorial(n: Column) -> Column:
    """ln n! for whole n >= 0: a table up to 15, Stirling's series beyond (exact to 1e-13)."""
    x = n.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return F.when(n < len(_SMALL), F.element_at(F.array(*[F.lit(v) for v in _SMALL]), (F.least(n, F.lit(len(_SMALL) - 1)) + 1).cast("int"))).otherwise(series)


def _log_choose(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def fisher_exact(df: DataFrame, a: str = "a", b: str = "b", c: str = "c", d: str = "d", name: str = "p") -> DataFrame:
    """Two-sided p of the 2 x 2 table (a, b; c, d): the sum of the probabilities of tables with these margins that are no likelier. Null where a row is empty."""
    r1, r2, k = F.col(a) + F.col(b), F.col(c) + F.col(d), F.col(a) + F.col(c)
    n = r1 + r2
    prob = lambda x: F.exp(_log_choose(r1, x) + _log_choose(r2, k - x) - _log_choose(n, k))
    support = F.sequence(F.greatest(F.lit(0), (k - r2).cast("int")).cast("int"), F.least(k, r1).cast("int"))
    own = prob(F.col(a))
    total = F.aggregate(F.filter(F.transform(support, prob), lambda p: p <= own * (1 + 1e-7)), F.lit(0.0), lambda s, p: s + p)
    return df.withColumn(name, F.when((r1 > 0) & (r2 > 0), F.least(F.lit(1.0), total)))


def binomial_tail(df: DataFrame, k: str, n: str, p: float | str = 0.5, two_sided: bool = False, name: str = "p") -> DataFrame:
    """P(X >= k) of n trials, or twice the smaller tail (p = 0.5) for the sign test."""
    chance = F.lit(float(p)) if isinstance(p, float) else F.col(p)
    first = F.greatest(F.col(k), F.col(n) - F.col(k)) if two_sided else F.col(k)
    term = lambda x: F.exp(_log_choose(F.col(n), x) + x * F.log(chance) + (F.col(n) - x) * F.log(1 - chance))
    total = F.aggregate(F.transform(F.sequence(first.cast("int"), F.col(n).cast("int")), term), F.lit(0.0), lambda s, x: s + x)
    return df.withColumn(name, F.least(F.lit(1.0), 2 * total) if two_sided else F.least(F.lit(1.0), total))


def _z(alpha: float | Column | None) -> Column | float:
    """The two-sided normal quantile of a level; of 0.05 where none is given."""
    if isinstance(alpha, Column):
        return normal.quantile(1 - alpha / 2)
    return Z_975 if alpha is None else NormalDist().inv_cdf(1 - alpha / 2)


def wilson(x: Column, n: Column, z: float | Column = Z_975) -> tuple[Column, Column]:
    p, m = x / n, 1 + z * z / n
    middle, half = (p + z * z / (2 * n)) / m, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / m
    return middle - half, middle + half


def newcombe(df: DataFrame, x1: str, n1: str, x0: str, n0: str, z: float | Column = Z_975, alpha: float | Column | None = None) -> DataFrame:
    """diff, low, high of p1 - p0 by the hybrid of Wilson's intervals, at the level alpha (a number or a column), or for the quantile z."""
    z = z if alpha is None else _z(alpha)
    if isinstance(z, Column):  # taken once, and not in each of the places where it stands
        df, z = df.withColumn("_z", z), F.col("_z")
    p1, p0 = F.col(x1) / F.col(n1), F.col(x0) / F.col(n0)
    l1, u1 = wilson(F.col(x1), F.col(n1), z)
    l0, u0 = wilson(F.col(x0), F.col(n0), z)
    return df.withColumns({"diff": p1 - p0, "low": p1 - p0 - F.sqrt((p1 - l1) ** 2 + (u0 - p0) ** 2), "high": p1 - p0 + F.sqrt((u1 - p1) ** 2 + (p0 - l0) ** 2)}).drop("_z")


def cohen_kappa(df: DataFrame, first: str, second: str, by: Sequence[str] = ()) -> DataFrame:
    """Agreement and kappa of two raters' booleans; null where chance agreement is 1. Rows that either left out don't count."""
    a, b = F.col(first).cast("boolean"), F.col(second).cast("boolean")
    out = df.filter(a.isNotNull() & b.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg((a == b).cast("int")).alias("agreement"), F.avg(a.cast("int")).alias("_a"), F.avg(b.cast("int")).alias("_b"))
    chance = F.col("_a") * F.col("_b") + (1 - F.col("_a")) * (1 - F.col("_b"))
    return out.withColumn("kappa", F.when(chance < 1, (F.col("agreement") - chance) / (1 - chance))).drop("_a", "_b")


def mantel_haenszel(df: DataFrame, by: Sequence[str] = (), a: str = "a", b: str = "b", c: str = "c", d: str = "d", alpha: float | None = None) -> DataFrame:
    """Common odds ratio over strata (rows of 2 x 2 tables) with its interval (Robins, Breslow and Greenland; 95 % unless alpha says otherwise), and the test
    statistic with continuity correction and its p (chi-square, one degree of freedom)."""
    z = _z(alpha)
    A, B, C, D = (F.col(x).cast("double") for x in (a, b, c, d))
    n = A + B + C + D
    R, S, P, Q = A * D / n, B * C / n, (A + D) / n, (B + C) / n
    variance = (A + B) * (C + D) * (A + C) * (B + D) / (n * n * (n - 1))
    out = df.filter(n > 1).groupBy(*by).agg(
        F.count("*").alias("n_strata"), F.sum(R).alias("_r"), F.sum(S).alias("_s"), F.sum(P * R).alias("_pr"), F.sum(P * S + Q * R).alias("_ps"), F.sum(Q * S).alias("_qs"), F.sum(A - (A + B) * (A + C) / n).alias("_gap"), F.sum(variance).alias("_var")
    )
    ratio = F.col("_r") / F.when(F.col("_s") > 0, F.col("_s"))
    se = F.sqrt(F.col("_pr") / (2 * F.col("_r") ** 2) + F.col("_ps") / (2 * F.col("_r") * F.col("_s")) + F.col("_qs") / (2 * F.col("_s") ** 2))
    chi2 = F.greatest(F.lit(0.0), F.abs("_gap") - 0.5) ** 2 / F.when(F.col("_var") > 0, F.col("_var"))
    out = out.select(*by, "n_strata", ratio.alias("odds_ratio"), (ratio * F.exp(-z * se)).alias("low"), (ratio * F.exp(z * se)).alias("high"), chi2.alias("chi2"))
    return out.withColumn("p", normal.chi_square_tail(F.col("chi2"), 1))


def _binomial(m: int, q: float) -> tuple[int, np.ndarray]:
    """(least, chances): the chances of least, least + 1, ... successes of m trials, as far as doubles hold them. Beyond 20 roots of m from the mean they are
    under 1e-347 (Hoeffding), which is 0 as a double; so there are at most 40 roots of m."""
    if q <= 0 or q >= 1:
        return (m if q >= 1 else 0), np.ones(1)
    mode, reach = min(m, int((m + 1) * q)), math.ceil(20 * math.sqrt(m)) + 1
    up, down = np.arange(mode, min(m, mode + reach)), np.arange(mode, max(0, mode - reach), -1)
    odds = math.log(q) - math.log1p(-q)
    right = np.cumsum(np.log((m - up) / (up + 1)) + odds)
    left = np.cumsum(np.log(down / (m - down + 1)) - odds)
    chances = np.exp(np.concatenate([left[::-1], [0.0], right]))
    return _trimmed(mode - len(left), chances / chances.sum())


def _trimmed(least: int, chances: np.ndarray) -> tuple[int, np.ndarray]:
    """Without what is 0 as a double at either end."""
    some = np.flatnonzero(chances > _TINY)
    return least + int(some[0]), chances[some[0] : some[-1] + 1]


#: The least normal double: what is smaller has lost digits.
_TINY = float(np.finfo(float).tiny)


def matched_chances(kinds: Sequence[tuple[int, float]], n_cases: int) -> tuple[float, float]:
    """(p_upper, p): the chance that a sum of binomials, kinds of m trials at chance q, is at least n_cases, and that of any sum no likelier than n_cases."""
    least, chances = 0, np.ones(1)
    for m, q in kinds:
        first, one = _binomial(m, q)
        least, chances = _trimmed(least + first, np.convolve(chances, one))
    at = n_cases - least
    own = chances[at] if 0 <= at < len(chances) else 0.0
    return float(min(1.0, chances[max(0, at) :].sum())), float(min(1.0, chances[chances <= own * (1 + 1e-7)].sum()))


def matched_set_test(df: DataFrame, case: str, flag: str, members: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(*by, n_sets, n_left_out, n_cases, expected, p_upper, p): exact test that the case of a matched set (`case`: which row it is) has the flag no more
    often than its controls. members: the columns that name a set within `by`.

    The labels are permuted within each set: with k flags among its n rows, a set's case has one with chance k / n, so that the number of flagged
    cases is a sum of independent draws. Sets with the same k and n are one binomial, and these are convolved, instead of going through all
    arrangements. p_upper is the chance of at least as many, p that of anything no likelier. Sets without exactly one case or without a
    control are left out and counted. Flags that are null count as false. Chances too small for a double are 0, so that a group of S sets keeps some 40 roots of S
    chances, and costs S products for each kind of set (k of n)."""
    on = F.coalesce(F.col(flag).cast("boolean"), F.lit(False))
    is_case = F.coalesce(F.col(case).cast("boolean"), F.lit(False))
    sets = df.groupBy(*by, *members).agg(F.count("*").alias("_n"), F.count_if(on).alias("_k"), F.count_if(is_case).alias("_cases"), F.count_if(on & is_case).alias("_x"))
    good = (F.col("_cases") == 1) & (F.col("_n") > 1)
    kinds = sets.groupBy(*by, "_n", "_k").agg(F.count_if(good).alias("_m"), F.count_if(~good).alias("_out"), F.sum(F.when(good, F.col("_x")).otherwise(0)).alias("_x"))
    q = F.col("_k") / F.col("_n")
    kind = F.struct(F.col("_m").alias("m"), q.alias("q"))
    out = kinds.groupBy(*by).agg(
        F.sum("_m").alias("n_sets"), F.sum("_out").alias("n_left_out"), F.sum("_x").alias("n_cases"), F.sum(F.col("_m") * q).alias("expected"),
        F.array_sort(F.collect_list(F.when(F.col("_m") > 0, kind))).alias("_kinds"),
    )

    def test(batches):
        for part in batches:
            pairs = [matched_chances([(k["m"], k["q"]) for k in row], n) if n_sets else (None, None) for row, n, n_sets in zip(part["_kinds"], part["n_cases"], part["n_sets"])]
            yield part.drop(columns="_kinds").assign(p_upper=pd.array([p[0] for p in pairs], "Float64"), p=pd.array([p[1] for p in pairs], "Float64"))

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.drop("_kinds").schema)
    return out.mapInPandas(test, f"{names}, p_upper double, p double")


def signed_rank_p(values: Sequence[float]) -> float:
    """Two-sided exact p of the Wilcoxon signed-rank test; zeros are left out, ties share their mean rank."""
    x = np.array([v for v in values if v is not None and not math.isnan(v) and v != 0])
    if not len(x):
        return math.nan
    ranks = pd.Series(np.abs(x)).rank().to_numpy()
    twice = np.rint(2 * ranks).astype(int)
    ways = np.zeros(twice.sum() + 1)
    ways[0] = 1.0
    for r in twice:
        ways[r:] = ways[r:] + ways[: len(ways) - r]
    ways /= ways.sum()
    low = int(min(twice[x > 0].sum(), twice[x < 0].sum()))
    return float(min(1.0, 2 * ways[: low + 1].sum()))


def wilcoxon(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """(*by, n, w_plus, p): exact test that each group's values are symmetric about zero."""

    def test(part: pd.DataFrame) -> pd.DataFrame:
        x = part[value].dropna().to_numpy(float)
        x = x[x != 0]
        ranks = pd.Series(np.abs(x)).rank().to_numpy() if len(x) else x
        return pd.DataFrame([{c: part[c].iloc[0] for c in by} | {"n": len(x), "w_plus": float(ranks[x > 0].sum()), "p": signed_rank_p(x) if len(x) else None}])

    keys = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    return df.select(*by, value).groupBy(*by).applyInPandas(test, f"{keys}, n long, w_plus double, p double")


#: Nodes and weights on [-1, 1], and how many standard deviations to either side of the mean are integrated over.
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(400)
_REACH = 12.0


def _angles(a: float, b: float) -> tuple[float, float]:
    """Where a Beta(a, b) rate lies but for less than 1e-30, as angles whose squared sine is the rate."""
    middle, width = math.asin(math.sqrt(a / (a + b))), _REACH / (2 * math.sqrt(a + b))
    return max(0.0, middle - width), min(math.pi / 2, middle + width)


def jeffreys_chance(x1: float, n1: float, x0: float, n0: float, margin: float = 0.0) -> float:
    """P(p1 > p0 + margin) where the rates have the posteriors Beta(x + 1/2, n - x + 1/2): the density of the one times the incomplete beta
    function of the other, by quadrature over the angle whose squared sine is the rate, on which the density is smooth. The incomplete beta function
    has a bend where its argument, the rate less the margin, is 0 or 1, and rises only where the other rate lies: these places part the integral, and in each
    part the nodes lie square-close to both ends, which smooths the roots there."""
    a, b, c, d = x1 + 0.5, n1 - x1 + 0.5, x0 + 0.5, n0 - x0 + 0.5
    low, high = _angles(a, b)
    bends = [margin, 1 + margin, *(math.sin(t) ** 2 + margin for t in _angles(c, d))]
    inner = [math.asin(math.sqrt(r)) for r in bends if 0 < r < 1]
    edges = sorted({low, high, *(t for t in inner if low < t < high)})
    total = 0.0
    for start, end in zip(edges, edges[1:]):
        turn = math.pi * (_NODES + 1) / 2
        angle = start + (end - start) * (1 - np.cos(turn)) / 2
        density = 2 * np.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + (2 * a - 1) * np.log(np.sin(angle)) + (2 * b - 1) * np.log(np.cos(angle)))
        weight = density * _WEIGHTS * (end - start) * math.pi / 4 * np.sin(turn)
        below = np.array([beta_inc(c, d, r - margin) for r in (np.sin(angle) ** 2).tolist()])
        total += weight @ below
    return float(min(1.0, max(0.0, total)))


def jeffreys(df: DataFrame, x1: str, n1: str, x0: str, n0: str, margin: float = 0.1) -> DataFrame:
    """p_higher and p_margin: posterior chances that rate 1 is higher, and higher by more than `margin`, with Jeffreys priors; exact to about 1e-10."""

    def run(batches):
        for part in batches:
            rows = list(zip(part[x1], part[n1], part[x0], part[n0]))
            yield part.assign(p_higher=[jeffreys_chance(*r) for r in rows], p_margin=[jeffreys_chance(*r, margin) for r in rows])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{kinds}, p_higher double, p_margin double")


def power_of_fisher(df: DataFrame, n1: str, n0: str, p1: str, p0: str, alpha: float = 0.05) -> DataFrame:
    """df with `power`: the chance that Fisher's test on n1 and n0 trials at rates p1 and p0 gives p < alpha, by going through all outcomes as rows. A p that
    is alpha itself but for rounding (a billionth of it) is not less."""
    keys = df.columns
    grid = df.withColumn("_x1", F.explode(F.sequence(F.lit(0), F.col(n1).cast("int")))).withColumn("_x0", F.explode(F.sequence(F.lit(0), F.col(n0).cast("int"))))
    grid = grid.withColumns({"_b": F.col(n1) - F.col("_x1"), "_d": F.col(n0) - F.col("_x0")})
    tested = fisher_exact(grid, "_x1", "_b", "_x0", "_d", "_p")
    chance = lambda x, n, p: F.exp(_log_choose(n, x)) * F.pow(p, x) * F.pow(1 - p, n - x)
    weight = chance(F.col("_x1"), F.col(n1), F.col(p1)) * chance(F.col("_x0"), F.col(n0), F.col(p0))
    return tested.groupBy(*keys).agg(F.sum(F.when(F.col("_p") < alpha * (1 - 1e-9), weight).otherwise(0.0)).alias("power"))


def rates(df: DataFrame, flag: str, by: Sequence[str]) -> DataFrame:
    """n, n_true and the rate of a boolean per group."""
    on = F.col(flag).cast("boolean")
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(on).alias("n_true"), (F.count_if(on) / F.count("*")).alias("rate"))


def median_bootstrap(df: DataFrame, value: str, by: Sequence[str], draws: int = 1000, seed: int = 7) -> DataFrame:
    """(*by, b, median): medians of resamples of the group's values, chosen by a hash."""
    rows = df.filter(F.col(value).isNotNull()).select(*by, value)
    rows = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(value)) - 1)
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    picks = sizes.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("_j", F.explode(F.sequence(F.lit(0), (F.col("_n") - 1).cast("int"))))
    picks = picks.withColumn("_i", draw(seed, F.col("_n"), *[F.col(c) for c in by], F.col("b"), F.col("_j")).cast("int"))
    return picks.join(rows, [*by, "_i"]).groupBy(*by, "b").agg(F.median(value).alias("median"))


def agreement(first: DataFrame, second: DataFrame, flags: Sequence[str], on: Sequence[str] = ("window_id",)) -> DataFrame:
    """(flag, n, n_agree, agreement, kappa) of two runs over the same windows: rows that both have, one line for each of the boolean columns
    `flags`. What a run leaves null doesn't count."""
    on = list(on)
    one = first.select(*on, *[F.col(c).cast("boolean").alias(f"{c}_1") for c in flags])
    two = second.select(*on, *[F.col(c).cast("boolean").alias(f"{c}_2") for c in flags])
    pairs = F.array(*[F.struct(F.lit(c).alias("flag"), F.col(f"{c}_1").alias("a"), F.col(f"{c}_2").alias("b")) for c in flags])
    each = one.join(two, on).select(F.inline(pairs))
    out = cohen_kappa(each, "a", "b", ["flag"])
    return out.withColumn("n_agree", F.round(F.col("agreement") * F.col("n")).cast("long"))


def excluded(primary: DataFrame, stable: DataFrame, on: Sequence[str] = ("asset", "d")) -> DataFrame:
    """Transitions of the primary run that didn't last: rows of primary without a partner in stable. Dates that are null in either have none."""
    return primary.join(stable.select(*on).distinct(), list(on), "left_anti")


def told_on(rows: DataFrame, narratives: DataFrame, day: str = "d", boundary: str = "boundary") -> DataFrame:
    """rows with the narrative of their day, if any: `told` says so. Of several narratives of a day the least window_id is taken."""
    one = narratives.groupBy(F.col(boundary).alias(day)).agg(F.min(F.struct("window_id", "summary", "is_confident")).alias("_t"))
    out = rows.join(one, day, "left")
    return out.select(*rows.columns, F.col("_t").isNotNull().alias("told"), "_t.window_id", "_t.summary", "_t.is_confident")
