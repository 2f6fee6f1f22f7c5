"""How far apart two states are: volatility ratios, tests and bootstrap intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.tails import f_upper_tail, t_two_sided
from tidemark.operators.series import TRADING_DAYS


def _of(value: str, state: str, s: int) -> Column:
    return F.when(F.col(state) == s, F.col(value))


def vol_separation(df: DataFrame, value: str = "ret", state: str = "state", by: Sequence[str] = ("asset",)) -> DataFrame:
    """Per key and state 0/1: n, mean, sample deviation, annual volatility; their ratio, Levene's W (about medians) and Welch's t with degrees of
    freedom. Rows whose value or state is null don't count; all is null but the counts where a state has fewer than two rows."""
    rows = df.filter(F.col(value).isNotNull() & F.col(state).isin(0, 1))
    medians = rows.groupBy(*by, state).agg(F.median(value).alias("_m"))
    rows = rows.join(medians, [*by, state]).withColumn("_z", F.abs(F.col(value) - F.col("_m")))
    aggs = []
    for s in (0, 1):
        x, z = _of(value, state, s), _of("_z", state, s)
        aggs += [F.count(x).alias(f"n{s}"), F.avg(x).alias(f"mean{s}"), F.stddev_samp(x).alias(f"std{s}"), F.avg(z).alias(f"_zm{s}"), F.var_pop(z).alias(f"_zv{s}")]
    out = rows.groupBy(*by).agg(*aggs, F.avg("_z").alias("_zm"))
    n0, n1 = F.col("n0"), F.col("n1")
    enough = (n0 >= 2) & (n1 >= 2)
    between = n0 * (F.col("_zm0") - F.col("_zm")) ** 2 + n1 * (F.col("_zm1") - F.col("_zm")) ** 2
    within = n0 * F.col("_zv0") + n1 * F.col("_zv1")
    a, b = F.col("std0") ** 2 / n0, F.col("std1") ** 2 / n1
    some = lambda c: F.when(enough, c)
    nonzero = lambda c: F.when(c != 0, c)
    return out.withColumns({
        "vol0": F.col("std0") * F.sqrt(F.lit(float(TRADING_DAYS))),
        "vol1": F.col("std1") * F.sqrt(F.lit(float(TRADING_DAYS))),
        "ratio": some(F.col("std1") / nonzero(F.col("std0"))),
        "levene_w": some((n0 + n1 - 2) * between / nonzero(within)),
        "welch_t": some((F.col("mean1") - F.col("mean0")) / nonzero(F.sqrt(a + b))),
        "welch_df": some((a + b) ** 2 / nonzero(a**2 / (n0 - 1) + b**2 / (n1 - 1))),
    }).drop("_zm", "_zm0", "_zm1", "_zv0", "_zv1")


def with_p_values(separation: DataFrame) -> DataFrame:
    """vol_separation with the p-values of Levene's and Welch's tests."""
    return separation.withColumns({
        "levene_p": f_upper_tail(F.col("levene_w"), F.lit(1.0), (F.col("n0") + F.col("n1") - 2).cast("double")),
        "welch_p": t_two_sided(F.col("welch_t"), F.col("welch_df")),
    })


def forward_separation(df: DataFrame, value: str = "fvol", state: str = "state", by: Sequence[str] = ("asset",)) -> DataFrame:
    """Mean and median of forward volatility in each state and their ratios; no p-value, since the windows overlap."""
    x0, x1 = _of(value, state, 0), _of(value, state, 1)
    out = df.groupBy(*by).agg(F.count(x0).alias("n0"), F.count(x1).alias("n1"), F.avg(x0).alias("mean0"), F.avg(x1).alias("mean1"), F.median(x0).alias("median0"), F.median(x1).alias("median1"))
    ratio = lambda n: F.col(f"{n}1") / F.when(F.col(f"{n}0") != 0, F.col(f"{n}0"))
    return out.withColumns({"mean_ratio": ratio("mean"), "median_ratio": ratio("median")})


def per_fold_ratios(df: DataFrame, value: str = "ret", state: str = "state", by: Sequence[str] = ("asset", "fold"), order: str = "d") -> DataFrame:
    """Ratio of deviations in each fold; null unless both states have two rows and the calm one varies."""
    x0, x1 = _of(value, state, 0), _of(value, state, 1)
    out = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count(x0).alias("n0"), F.count(x1).alias("n1"), F.stddev_samp(x0).alias("std0"), F.stddev_samp(x1).alias("std1"))
    fine = (F.col("n0") >= 2) & (F.col("n1") >= 2) & (F.col("std0") > 0)
    return out.withColumn("ratio", F.when(fine, F.col("std1") / F.col("std0")))


def fold_summary(ratios: DataFrame, by: Sequence[str] = ("asset",)) -> DataFrame:
    return ratios.groupBy(*by).agg(F.count("ratio").alias("n_folds"), F.median("ratio").alias("median_ratio"), F.avg("ratio").alias("mean_ratio"), F.count_if(F.col("ratio") > 1).alias("n_above_one"))


def draw(seed: int, n: Column, *keys: Column) -> Column:
    """A number in [0, n) from a hash of the seed and the keys: the same in any engine with md5 over text."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % n


def block_bootstrap(df: DataFrame, value: str = "ret", state: str = "state", by: Sequence[str] = ("asset",), order: str = "d", draws: int = 200, block: int = 20, seed: int = 7, inclusive: bool = False) -> DataFrame:
    """(*by, b, ratio): ratio of deviations of moving-block resamples. ceil(n / block) blocks start anywhere in [0, n - block) (inclusive: and at n - block), are
    put together and cut to n rows. Draws and blocks are rows, dealt out by key and draw; what a block holds is the difference of two running sums,
    so that no block is laid out row by row. Values are taken from the key's mean, which keeps the sums of squares exact."""
    rows = df.filter(F.col(value).isNotNull() & F.col(state).isNotNull())
    rows = rows.join(rows.groupBy(*by).agg(F.avg(value).alias("_mean")), list(by)).withColumn("_x", F.col(value) - F.col("_mean"))
    run = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    names = [f"_{c}{k}" for k in (0, 1) for c in "nsq"]
    parts = [F.when(F.col(state) == k, v).otherwise(F.lit(0.0)) for k in (0, 1) for v in (F.lit(1.0), F.col("_x"), F.col("_x") ** 2)]
    place = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    sums = rows.select(*by, place.cast("long").alias("_at"), *[F.sum(p).over(run).alias(c) for p, c in zip(parts, names)])
    zero = rows.select(*by).distinct().select(*by, F.lit(0).cast("long").alias("_at"), *[F.lit(0.0).alias(c) for c in names])
    sums = sums.unionByName(zero)  # what stands before each place
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n")).filter(F.col("n") > block)
    starts = sizes.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / block) - 1).cast("int"))))
    room = F.col("n") - block + (1 if inclusive else 0)
    starts = starts.withColumn("s", draw(seed, room, *[F.col(c) for c in by], F.col("b"), F.col("j")))
    ends = F.col("s") + F.least(F.lit(block), F.col("n") - F.col("j") * block)
    edges = starts.select(*by, "b", F.inline(F.array(F.struct(F.col("s").alias("_at"), F.lit(-1.0).alias("_sign")), F.struct(ends.alias("_at"), F.lit(1.0).alias("_sign")))))
    out = edges.join(sums, [*by, "_at"]).groupBy(*by, "b").agg(*[F.sum(F.col("_sign") * F.col(c)).alias(c) for c in names])
    std = [F.sqrt(F.greatest(F.lit(0.0), F.col(f"_q{k}") - F.col(f"_s{k}") ** 2 / F.col(f"_n{k}")) / (F.col(f"_n{k}") - 1)) for k in (0, 1)]
    # A deviation this small beside the squares is a constant value.
    fine = (F.col("_n0") >= 2) & (F.col("_n1") >= 2)
    return out.select(*by, "b", F.when(fine, F.when(std[0] > 1e-9 * F.sqrt(F.col("_q0")), std[1] / std[0])).alias("ratio"))


def quantile_interval(df: DataFrame, value: str, by: Sequence[str], alpha: float = 0.05, least: int = 50) -> DataFrame:
    """Interpolated quantiles alpha/2 and 1 - alpha/2 of the values that aren't null; null if there are fewer than `least`."""
    low, high = alpha / 2, 1 - alpha / 2
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.percentile(value, F.lit(low)).alias("low"), F.percentile(value, F.lit(high)).alias("high"))
    return out.withColumns({c: F.when(F.col("n") >= least, F.col(c)) for c in ("low", "high")})
