"""Ranks, running sums and quantiles in the order of a column. Values are first counted, then cut into ranges of
about equal numbers of rows; sums of whole ranges (RANGES at most) are accumulated, and a window runs inside one
range only. So no task sees all values of a column, however many distinct ones it has."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGES = 1_024
#: Rows of a range, about, while there are fewer than RANGES.
RANGE_ROWS = 50_000
#: Rows of the sample that the bounds of ranges come from, about.
SAMPLE_ROWS = 50_000
#: Ranges of columns that are no numbers or times.
TEXT_RANGES = 64


def _double(df: DataFrame, column: str):
    x = F.col(f"`{column}`")
    kind = df.schema[column].dataType
    return (x.cast("timestamp") if isinstance(kind, (T.TimestampNTZType, T.DateType)) else x).cast("double")


def bounds(df: DataFrame, columns: list[str]) -> list[list[float]]:
    """Ascending inner bounds of the ranges of each column: quantiles of a sample of about SAMPLE_ROWS rows, which say
    where to cut and nothing else, so results don't depend on them."""
    values = df.select(*(_double(df, c).alias(f"_{i}") for i, c in enumerate(columns)))
    n = values.count()
    ranges = min(RANGES, max(16, 1 << math.ceil(math.log2(max(1.0, n / RANGE_ROWS)))))
    sample = values.sample(min(1.0, SAMPLE_ROWS / max(1, n)), 17) if n > SAMPLE_ROWS else values
    steps = F.array(*(F.lit(k / ranges) for k in range(1, ranges)))
    row = sample.agg(*(F.approx_percentile(f"_{i}", steps, 4 * ranges).alias(f"_{i}") for i in range(len(columns)))).first()
    return [sorted({v for v in row[f"_{i}"] or [] if v is not None and math.isfinite(v)}) for i in range(len(columns))]


def with_range(df: DataFrame, column: str, name: str, inner: list[float] | None = None) -> DataFrame:
    """df with the number of the range of each known value of a numeric or time column; 0 where it is null."""
    inner = bounds(df, [column])[0] if inner is None else inner
    if not inner:
        return df.withColumn(name, F.lit(0))
    marked = df.withColumn("_x", F.coalesce(_double(df, column), F.lit(-math.inf)))
    cut = Bucketizer(splits=[-math.inf, *inner, math.inf], inputCol="_x", outputCol=name, handleInvalid="keep")
    return cut.transform(marked).withColumn(name, F.col(name).cast("int")).drop("_x")


def counted(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, _b, value, n): how often each known value of each column occurs, and the value's range."""
    rows = df.select(*(F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(columns)))
    inner = bounds(rows, rows.columns)
    for i, cuts in enumerate(inner):
        rows = with_range(rows, f"v{i}", f"b{i}", cuts)
    pairs = [F.struct(F.lit(c).alias("column"), F.col(f"b{i}").alias("_b"), F.col(f"v{i}").alias("value")) for i, c in enumerate(columns)]
    return rows.select(F.inline(F.array(*pairs))).where("value is not null").groupBy("column", "_b", "value").agg(F.count("*").alias("n"))


def running(counts: DataFrame, order: list[str], sums: list[str], by: list[str] | None = None) -> DataFrame:
    """counts, whose rows know their range _b, with upto_x for each x of sums: its sum over rows up to this one in
    the order of the columns `order`, and all_x, its sum over all; both within each value of `by`."""
    by = by or []
    whole = counts.groupBy(*by, "_b").agg(*(F.sum(s).alias(f"_s_{s}") for s in sums))
    # A row for each range, RANGES at most.
    before, every = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    whole = whole.select(
        *(F.col(c).alias(f"_k{i}") for i, c in enumerate([*by, "_b"])), *(F.coalesce(F.sum(f"_s_{s}").over(before), F.lit(0)).alias(f"_before_{s}") for s in sums), *(F.sum(f"_s_{s}").over(every).alias(f"all_{s}") for s in sums)
    )
    inside = Window.partitionBy(*by, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = counts.withColumns({f"_in_{s}": F.sum(s).over(inside) for s in sums})
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate([*by, "_b"])]
    joined = rows.join(F.broadcast(whole) if not by else whole, same)
    return joined.select(*counts.columns, *((F.col(f"_before_{s}") + F.col(f"_in_{s}")).alias(f"upto_{s}") for s in sums), *(f"all_{s}" for s in sums))


def average_ranks(df: DataFrame, column: str) -> DataFrame:
    """(value, rank): the average rank of each distinct value."""
    ranked = running(counted(df, [column]), ["value"], ["n"])
    return ranked.select("value", (F.col("upto_n") - (F.col("n") - 1) / 2.0).alias("rank"))


def quantiles_of(counts: DataFrame, probabilities: list[float]) -> DataFrame:
    """(column, n, n_unique, q): exact linear quantiles of counted values; a row for each column with known values."""
    ranked = running(counts, ["value"], ["n"], ["column"]).withColumn("_from", F.col("upto_n") - F.col("n"))

    def pick(index):
        return F.max(F.when((F.col("_from") <= index) & (index < F.col("upto_n")), F.col("value")))

    found = []
    for p in probabilities:
        at = F.lit(p) * (F.col("all_n") - 1)
        found += [pick(F.floor(at)), pick(F.ceil(at))]
    out = ranked.groupBy("column").agg(F.max("all_n").alias("n"), F.count("*").alias("n_unique"), F.array(*found).alias("f"))

    def between(i: int, p: float):
        at = F.lit(p) * (F.col("n") - 1)
        low, high = F.col("f")[2 * i], F.col("f")[2 * i + 1]
        return low + (high - low) * (at - F.floor(at))

    return out.select("column", "n", "n_unique", F.array(*(between(i, p) for i, p in enumerate(probabilities))).alias("q"))


def quantiles(df: DataFrame, columns: list[str], probabilities: list[float]) -> dict[str, list[float] | None]:
    """The quantiles of each column; None for a column without known values. A row a column reaches the driver."""
    found = {r.column: list(r.q) for r in quantiles_of(counted(df, columns), probabilities).collect()}
    return {c: found.get(c) for c in columns}


def median_by(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """(_g0, ..., _v): the exact median of the known values of a numeric column for each value of the columns `by`. The ranges are
    those of the whole column, so a group of any size is spread over them."""
    keys = [f"_g{i}" for i in range(len(by))]
    known = df.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(by, keys, strict=True)), F.col(f"`{column}`").cast("double").alias("value")).where("value is not null")
    counts = with_range(known, "value", "_b").groupBy(*keys, "_b", "value").agg(F.count("*").alias("n"))
    ranked = running(counts, ["value"], ["n"], keys).withColumn("_from", F.col("upto_n") - F.col("n"))
    middle = [F.max(F.when((F.col("_from") <= at) & (at < F.col("upto_n")), F.col("value"))) for at in (F.floor((F.col("all_n") - 1) / 2), F.floor(F.col("all_n") / 2))]
    return ranked.groupBy(*keys).agg(((middle[0] + middle[1]) / 2).alias("_v"))


def text_bounds(values: DataFrame) -> list:
    """Rows (column, value) that cut distinct (column, value) strings into ranges, from a bounded sample."""
    known = values.where("value is not null")
    some = known.orderBy(F.xxhash64("column", "value"), "column", "value").limit(32 * TEXT_RANGES).select("column", F.left("value", F.lit(200)).alias("value")).collect()
    return sorted(set(some))[:: max(1, len(some) // TEXT_RANGES)]


def with_codes(values: DataFrame) -> DataFrame:
    """values, whose (column, value) are distinct strings, with code: the number of smaller known values of the column,
    -1 for null."""
    cuts = text_bounds(values)
    limits = F.array(*(F.struct(F.lit(r.column).alias("column"), F.lit(r.value).alias("value")) for r in cuts))
    key = F.struct("column", "value")
    known = values.where("value is not null").withColumn("_b", F.size(F.filter(limits, lambda x: x <= key)) if cuts else F.lit(0)).withColumn("_one", F.lit(1).cast("long"))
    ranked = running(known, ["value"], ["_one"], ["column"])
    return ranked.select(*values.columns, (F.col("upto__one") - 1).alias("code")).unionByName(values.where("value is null").withColumn("code", F.lit(-1).cast("long")))
