"""Column expressions with the null, constant and non-finite rules of the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """Doubles; null where not finite or not a number."""
    d = x.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)


def corr(x: Column, y: Column) -> Column:
    """Pearson over the rows where both are known; null if fewer than two or either is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def skew(x: Column) -> Column:
    """Bias-adjusted skewness: null below three values, 0 for a constant."""
    n = F.count(x).cast("double")
    return F.when(n < 3, None).otherwise(F.coalesce(F.skewness(x), F.lit(0.0)) * F.sqrt(n * (n - 1)) / (n - 2))


def outside(x: Column, lower: Column, upper: Column) -> Column:
    return F.coalesce((x < lower) | (x > upper), F.lit(False))


def clip(x: Column, lower: Column, upper: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, lower), upper))


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def shuffle_key(key: Column, seed: int) -> Column:
    """A fixed pseudo-random order of rows, whatever their partitions."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))


def part_of_date(name: str, x: Column) -> Column:
    d = F.try_to_timestamp(x.cast("string"))
    parts = {
        "year": F.year(d), "month": F.month(d), "day": F.dayofmonth(d), "hour": F.hour(d), "minute": F.minute(d), "second": F.second(d),
        "quarter": F.quarter(d), "dayofyear": F.dayofyear(d), "dayofweek": F.weekday(d), "weekday": F.weekday(d), "weekofyear": F.weekofyear(d),
        "is_month_start": F.dayofmonth(d) == 1, "is_month_end": F.to_date(d) == F.last_day(d), "is_year_start": F.dayofyear(d) == 1,
        "is_quarter_start": (F.dayofmonth(d) == 1) & (F.month(d) % 3 == 1), "is_quarter_end": (F.to_date(d) == F.last_day(d)) & (F.month(d) % 3 == 0),
        "is_year_end": (F.month(d) == 12) & (F.dayofmonth(d) == 31), "is_leap_year": F.dayofyear(F.make_date(F.year(d), F.lit(12), F.lit(31))) == 366, "days_in_month": F.dayofmonth(F.last_day(d)),
    }
    if name not in parts:
        raise ValueError(f"unknown part of a date: {name}")
    return parts[name]
