"""Tail probabilities of test statistics. Those with closed forms are column expressions; the incomplete beta
and gamma functions are evaluated on the driver, for the one row that a test's aggregation gives."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ks_tail(d: Column, n1: Column, n2: Column, terms: int = 100) -> Column:
    """Kolmogorov's limit for the largest distance d between samples of n1 and n2; 1 below 0.2 / sqrt(n)."""
    x2 = d * d * n1 * n2 / (n1 + n2)
    term = lambda k: F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * x2)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda s, k: s + term(k))
    return F.when(x2 < 0.04, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def normality_z(moments: DataFrame) -> DataFrame:
    """moments, of columns n (double, 8 or more), skew and kurtosis, with z1 and z2: D'Agostino's normal score of
    a population skewness, and Anscombe and Glynn's of an excess kurtosis. Each step is a column, as one
    expression would repeat the former ones many times."""
    n, x, y, w2, root, a, below = map(F.col, ("n", "_x", "_y", "_w2", "_root", "_a", "_below"))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    spread = F.sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)))
    first = {
        "_y": F.col("skew") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2))),
        "_w2": F.sqrt(2 * (beta - 1)) - 1,
        "_x": (F.col("kurtosis") + 3 - 3 * (n - 1) / (n + 1)) / spread,
        "_root": 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))),
    }
    out = moments.withColumns(first).withColumn("_a", 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / (root * root))))
    out = out.withColumn("_below", 1 + x * F.sqrt(2 / (a - 4)))
    z1 = F.asinh(y / F.sqrt(2 / (w2 - 1))) / F.sqrt(F.log(w2) / 2)
    z2 = (1 - 2 / (9 * a) - F.signum(below) * F.cbrt((1 - 2 / a) / F.abs(below))) / F.sqrt(2 / (9 * a))
    return out.withColumns({"z1": z1, "z2": z2}).drop("_a", "_below", *first)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1) or tiny)
    out = d
    for m in range(1, 10_000):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1.0 + numerator * d or tiny)
            c = 1.0 + numerator / c or tiny
            out *= c * d
        if abs(c * d - 1.0) < 1e-14:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def chi_square_tail(x: float, df: float) -> float:
    """P(chi-square of df degrees > x)."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - front * total)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    out = d
    for k in range(1, 10_000):
        step = -k * (k - a)
        b += 2
        d = 1 / (step * d + b or 1e-300)
        c = b + step / c or 1e-300
        out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def f_tail(f: float, df1: float, df2: float) -> float:
    """P(F of df1 and df2 degrees > f)."""
    return 1.0 if f <= 0 else incomplete_beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


def t_tail(t: float, df: float) -> float:
    """P(|t of df degrees| > |t|)."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


# Coefficients of the normal quantile (Wichura's AS 241), numerator and denominator by rising power, for the middle and both tails. Fixed values.
QUANTILE_MIDDLE = (
    [3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727],
    [1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610],
)
QUANTILE_NEAR = (
    [1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4],
    [1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9],
)
QUANTILE_FAR = (
    [6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230, 0.0265321895265761230930, 0.00124266094738807843860, 2.71155556874348757815e-5, 2.01033439929228813265e-7],
    [1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15],
)
# Royston's polynomials (AS R94): of the two outer weights, by 1 / sqrt(n), and of mean and log deviation of log(1 - W), by n up to 11 and by log n above. Fixed values.
WEIGHT_OUTER = [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056]
WEIGHT_NEXT = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
FEW_BOUND, FEW_MEAN, FEW_DEVIATION = [-2.273, 0.459], [0.5440, -0.39978, 0.025054, -6.714e-4], [1.3822, -0.77857, 0.062767, -0.0020322]
MANY_MEAN, MANY_DEVIATION = [-1.5861, -0.31082, -0.083751, 0.0038915], [-0.4803, -0.082676, 0.0030302]


def polynomial(x: Column, coefficients: list[float]) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + F.lit(c)
    return out


def normal_quantile(p: Column) -> Column:
    """The standard normal value below which the share p, between 0 and 1, lies."""
    q = p - 0.5
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    ratio = lambda x, pair: polynomial(x, pair[0]) / polynomial(x, pair[1])
    tail = F.when(r <= 5, ratio(r - 1.6, QUANTILE_NEAR)).otherwise(ratio(r - 5, QUANTILE_FAR))
    return F.when(F.abs(q) <= 0.425, q * ratio(0.180625 - q * q, QUANTILE_MIDDLE)).otherwise(F.signum(q) * tail)


@F.pandas_udf(T.DoubleType())
def normal_tail(z: pd.Series) -> pd.Series:
    """P(standard normal > z), of the few rows that tests give."""
    return z.map(lambda x: 0.5 * math.erfc(x / math.sqrt(2)), na_action="ignore").astype(float)


#: Two samples of at most so many values have an exact tail.
EXACT_ROWS = 10_000


def ks_exact(d: float, n1: int, n2: int) -> float:
    """P(largest distance of the two samples' distributions >= d) if all orders of n1 and n2 values are alike: the share of lattice
    paths from (0, 0) to (n1, n2) that somewhere come as far from the diagonal. Of the paths to (i, j) the share i / (i + j) comes by
    (i - 1, j), so the share of those that were outside is a mean of two, a diagonal i + j at a time. Nothing is taken off
    anything, so small values are as exact as large ones."""
    n1, n2 = max(n1, n2), min(n1, n2)
    most = round(d * n1 * n2)  # distances are whole multiples of 1 / (n1 n2)
    if most <= 0:
        return 1.0
    j = np.arange(n2 + 1, dtype=np.int64)
    far = np.zeros(n2 + 1)  # by j, on the diagonal i + j = s
    for s in range(1, n1 + n2 + 1):
        # Points with 0 <= i <= n1 and 0 <= j <= n2.
        low, high = max(0, s - n1), min(n2, s)
        at = j[low : high + 1]
        by_i = (s - at) * far[low : high + 1]
        by_j = at * np.concatenate((far[low - 1 : low] if low else [0.0], far[low:high]))
        far[low : high + 1] = np.where(np.abs((s - at) * n2 - at * n1) >= most, 1.0, (by_i + by_j) / s)
    return min(1.0, float(far[n2]))


def ks_tail_of(d: float, n1: int, n2: int) -> float:
    """The exact tail of two samples of up to EXACT_ROWS values, else Kolmogorov's limit."""
    if max(n1, n2) <= EXACT_ROWS:
        return ks_exact(d, n1, n2)
    x2 = d * d * n1 * n2 / (n1 + n2)
    return 1.0 if x2 < 0.04 else min(1.0, max(0.0, sum((2.0 if k % 2 else -2.0) * math.exp(-2.0 * k * k * x2) for k in range(1, 101))))


@F.pandas_udf(T.DoubleType())
def _ks_tails(d: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) else ks_tail_of(x, int(a), int(b)) for x, a, b in zip(d, n1, n2, strict=True)], dtype=float)


def ks_p_value(d: Column, n1: Column, n2: Column) -> Column:
    """The tail of the one row that a test gives: the limit as an expression, where both samples are small the exact value."""
    return F.when(F.greatest(n1, n2) <= EXACT_ROWS, _ks_tails(d, n1, n2)).otherwise(ks_tail(d, n1.cast("double"), n2))
