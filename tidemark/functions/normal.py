"""Quantile and tails of the normal distribution, and upper tails of chi-square, as column expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published coefficients of the rational approximation PPND16 (algorithm AS 241) of the normal quantile, numerators and
# denominators by rising power, for the middle, the shoulders and the far tails.
_MIDDLE = (
    [3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
     4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3],
    [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
     2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3],
)
_SHOULDER = (
    [1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
     1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4],
    [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9],
)
_TAIL = (
    [6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
     2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7],
    [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15],
)
#: Terms of the series of the normal distribution (below FAR), and steps of the continued fraction of its tail (beyond).
_TERMS, _STEPS, FAR = 90, 60, 4.5


def _as_column(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def _ratio(r: Column, coefficients: tuple[list[float], list[float]]) -> Column:
    top, bottom = (reduce(lambda total, c: total * r + F.lit(c), reversed(cs[:-1]), F.lit(cs[-1])) for cs in coefficients)
    return top / bottom


def quantile(p: Column | float) -> Column:
    """z with a share p of the normal distribution below it, to about 1e-15 of its value; null unless 0 < p < 1."""
    p = _as_column(p).cast("double")
    q = p - 0.5
    r = F.sqrt(-F.log(F.when(q < 0, p).otherwise(1 - p)))
    far = F.when(r <= 5, _ratio(r - 1.6, _SHOULDER)).otherwise(_ratio(r - 5, _TAIL))
    z = F.when(F.abs(q) <= 0.425, q * _ratio(0.180625 - q * q, _MIDDLE)).otherwise(F.when(q < 0, -far).otherwise(far))
    return F.when((p > 0) & (p < 1), z)


def _density(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def upper_tail(z: Column | float) -> Column:
    """The share of the normal distribution above z: a series near the middle, a continued fraction in the tails."""
    z = _as_column(z).cast("double")
    x = F.abs(z)
    near = F.least(x, F.lit(FAR))  # keeps the branch that isn't taken from overflowing
    step = lambda s, k: F.struct((s["t"] * near * near / (2 * k + 1)).alias("t"), (s["sum"] + s["t"] * near * near / (2 * k + 1)).alias("sum"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(_TERMS)), F.struct(near.alias("t"), near.alias("sum")), step, lambda s: s["sum"])
    wide = F.greatest(x, F.lit(FAR))
    fraction = F.aggregate(F.sequence(F.lit(_STEPS), F.lit(1), F.lit(-1)), wide, lambda d, k: wide + k / d)
    tail = F.when(x < FAR, 0.5 - _density(near) * series).otherwise(_density(wide) / fraction)
    return F.when(z < 0, 1 - tail).otherwise(tail)


def two_sided(z: Column | float) -> Column:
    """The chance of a normal value at least as far from zero as z."""
    return 2 * upper_tail(F.abs(_as_column(z)))


def chi_square_tail(x: Column, df: Column | int) -> Column:
    """P(chi-square with df degrees of freedom > x), in closed form for whole df: a finite sum, with the normal tail where df is odd. 1 for x <= 0;
    null for df < 1."""
    x, df = x.cast("double"), (F.lit(df) if isinstance(df, int) else df).cast("int")
    root, odd = F.sqrt(F.greatest(x, F.lit(0.0))), df % 2 == 1
    # Terms grow by x / j over the even or the odd j up to df - 2.
    first = F.when(odd, 2 * _density(root) * root).otherwise(F.exp(-x / 2))
    begin, count = F.when(odd, F.lit(3)).otherwise(F.lit(2)), F.floor((df - 1) / 2).cast("int")
    js = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: begin + 2 * i)
    step = lambda s, j: F.struct((s["t"] * x / j).alias("t"), (s["sum"] + s["t"] * x / j).alias("sum"))
    more = F.aggregate(F.slice(js, F.lit(1), F.greatest(count - F.when(odd, 1).otherwise(0), F.lit(0))), F.struct(first.alias("t"), first.alias("sum")), step, lambda s: s["sum"])
    total = F.when(odd, two_sided(root) + F.when(df > 1, more).otherwise(0.0)).otherwise(more)
    return F.when(df >= 1, F.when(x <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), total)))
