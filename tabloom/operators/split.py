"""Train and test parts and folds. Rows are put in the order of a digest of their key, so a split is the
same in every run and whatever the partitions are; positions come from counts by the first digits of that
digest and row numbers within those, so no window holds a whole table."""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.columns import shuffle_key
from tabloom.operators.ranges import RANGES, running, with_range

SEED = 42


def digits_for(rows: int) -> int:
    """Digits of a digest that deal so many rows into buckets of about 5,000."""
    return max(1, min(7, math.ceil(math.log(max(1, rows / 5_000), 16))))


def position(df: DataFrame, key: str, by: list[str] | None = None, seed: int = SEED, digits: int | None = None) -> DataFrame:
    """df with pos (1, 2, ...) in shuffled order, and n, the number of rows; both within each value of `by`."""
    by = by or []
    digits = digits_for(df.count()) if digits is None else digits
    rows = df.withColumn("_d", shuffle_key(F.col(key), seed)).withColumn("_b", F.substring("_d", 1, digits))
    counts = rows.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*by, "_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    # Buckets are summed up in two steps, by their first two digits and then by the rest.
    counts = counts.withColumn("_g", F.substring("_b", 1, 2))
    whole = counts.groupBy(*by, "_g").agg(F.sum("_n").alias("_s"))
    over = Window.partitionBy(*by).orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(*(F.col(c).alias(f"_w{i}") for i, c in enumerate([*by, "_g"])), F.coalesce(F.sum("_s").over(over), F.lit(0)).alias("_more"), F.sum("_s").over(Window.partitionBy(*by)).alias("n"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0))).join(whole, [F.col(c).eqNullSafe(F.col(f"_w{i}")) for i, c in enumerate([*by, "_g"])])
    counts = counts.select(*by, "_b", (F.col("_before") + F.col("_more")).alias("_before"), "n")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in [*by, "_b"]]
    joined = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_d", key))).alias("r").join(counts.alias("c"), same)
    return joined.select(*(F.col(f"r.`{c}`") for c in df.columns), (F.col("c._before") + F.col("r._i")).alias("pos"), "c.n")


def random_split(df: DataFrame, key: str, test_size: float = 0.2) -> DataFrame:
    return position(df, key).withColumn("part", F.when(F.col("pos") <= F.ceil(F.col("n") * F.lit(test_size)), "test").otherwise("train")).drop("pos", "n")


def stratified_split(df: DataFrame, key: str, target: str, test_size: float = 0.2) -> DataFrame:
    return position(df, key, [target]).withColumn("part", F.when(F.col("pos") <= F.round(F.col("n") * F.lit(test_size)), "test").otherwise("train")).drop("pos", "n")


def group_split(df: DataFrame, group: str, test_size: float = 0.2) -> DataFrame:
    """Whole groups; test_size is a share of groups."""
    groups = position(df.select(group).distinct(), group).select(F.col(group).alias("_g"), F.when(F.col("pos") <= F.ceil(F.col("n") * F.lit(test_size)), "test").otherwise("train").alias("part"))
    return df.join(groups, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def time_position(df: DataFrame, time: str, key: str) -> DataFrame:
    """df with pos in the order of time, nulls last, and of key, and n. Rows are counted by ranges of time and, in each, by
    buckets of the key, so neither a busy day nor one time of very many rows is one task's work."""
    rows = df.withColumn("_t", F.col(f"`{time}`").cast("timestamp")).withColumn("_k", F.col(f"`{key}`"))
    rows = with_range(rows, "_t", "_b").withColumn("_b", F.when(F.col("_t").isNull(), F.lit(RANGES)).otherwise(F.col("_b")))
    number = isinstance(df.schema[key].dataType, T.NumericType)
    rows = with_range(rows, "_k", "_kb") if number else rows.withColumn("_kb", F.lit(0))
    # Number of rows of each (time, range of the key) before the own one: times are distinct values now, not rows.
    counts = rows.groupBy("_b", "_t", "_kb").agg(F.count("*").alias("_n"))
    upto = running(counts, ["_t", "_kb"], ["_n"]).select(F.col("_t").alias("_u"), F.col("_kb").alias("_ub"), (F.col("upto__n") - F.col("_n")).alias("_before"), F.col("all__n").alias("n"))
    ranked = rows.withColumn("_i", F.row_number().over(Window.partitionBy("_t", "_kb").orderBy("_k")))
    joined = ranked.join(upto, F.col("_t").eqNullSafe(F.col("_u")) & (F.col("_kb") == F.col("_ub")))
    return joined.withColumn("pos", F.col("_before") + F.col("_i")).select(*(F.col(f"`{c}`") for c in df.columns), "pos", "n")


def time_split(df: DataFrame, time: str, key: str, test_size: float = 0.2) -> DataFrame:
    cutoff = F.greatest(F.lit(1), F.least(F.bround(F.col("n") * F.lit(1 - test_size)), F.col("n") - 1))
    return time_position(df, time, key).withColumn("part", F.when(F.col("pos") <= cutoff, "train").otherwise("test")).drop("pos", "n")


def fold_count(n: int) -> int:
    return 10 if n < 1000 else 5 if n <= 50000 else 3


def random_folds(df: DataFrame, key: str, k: int) -> DataFrame:
    """fold 0..k-1: consecutive stretches of the shuffled order; the first n mod k have one row more."""
    n, pos = F.col("n"), F.col("pos") - 1
    big = (n % k) * (F.floor(n / k) + 1)
    fold = F.when(pos < big, F.floor(pos / (F.floor(n / k) + 1))).otherwise(n % k + F.floor((pos - big) / F.greatest(F.floor(n / k), F.lit(1))))
    return position(df, key).withColumn("fold", fold.cast("int")).drop("pos", "n")


def stratified_folds(df: DataFrame, key: str, target: str, k: int) -> DataFrame:
    return position(df, key, [target]).withColumn("fold", ((F.col("pos") - 1) % k).cast("int")).drop("pos", "n")


def deal(sizes: list[tuple[int, int]], k: int) -> list[tuple[int, list[int]]]:
    """(size, how many of its groups go to folds 0, 0..1, ..., 0..k-1) of (size, number of groups), largest first, when each group in
    turn goes to the fold with the fewest rows, the first of equal ones. Groups of a size fill the folds up to a level, which
    is searched for; so the work depends on the number of sizes, not of groups."""
    rows, out = [0] * k, []
    for size, m in sizes:
        # A fold takes its next group at its rows then; groups go in the order of (rows, fold). Count those that go below a level.
        below = lambda level: [max(0, -(-(level - r) // size)) for r in rows]  # noqa: B023, E731
        low, high = min(rows), max(rows) + size * m + 1
        while low < high - 1:
            middle = (low + high) // 2
            low, high = (middle, high) if sum(below(middle)) <= m else (low, middle)
        taken = below(low)
        left = m - sum(taken)
        for f in [f for f in range(k) if rows[f] + taken[f] * size == low][:left]:
            taken[f] += 1
        rows = [r + t * size for r, t in zip(rows, taken, strict=True)]
        out.append((size, list(accumulate(taken))))
    return out


def group_folds(df: DataFrame, group: str, k: int) -> DataFrame:
    """Whole groups, each in turn, the largest first, to the fold with the fewest rows. Only the histogram of group sizes, with
    fewer entries than the root of twice the rows, is looked at in order; which groups of a size go to which fold says
    their shuffled order, by buckets. A null group is a group."""
    sizes = df.groupBy(F.col(f"`{group}`").alias("_g")).agg(F.count("*").alias("_rows"))
    histogram = [(r._rows, r.m) for r in sizes.groupBy("_rows").agg(F.count("*").alias("m")).orderBy(F.desc("_rows")).toLocalIterator()]
    upto = df.sparkSession.createDataFrame([(size, *bounds) for size, bounds in deal(histogram, k)], "_size long, " + ", ".join(f"_u{f} long" for f in range(k)))
    placed = position(sizes, "_g", ["_rows"]).join(upto, F.col("_rows") == F.col("_size"))
    fold = sum(((F.col("pos") > F.col(f"_u{f}")).cast("int") for f in range(k - 1)), F.lit(0))
    return df.join(placed.select("_g", fold.alias("fold")), F.col(f"`{group}`").eqNullSafe(F.col("_g"))).drop("_g")


def time_folds(df: DataFrame, time: str, key: str, k: int) -> DataFrame:
    """block 0..k: fold i trains on blocks up to i and validates on block i + 1; the first takes the rest."""
    size = F.floor(F.col("n") / (k + 1))
    first = F.col("n") - size * k
    block = F.when(F.col("pos") <= first, 0).otherwise(1 + F.floor((F.col("pos") - first - 1) / F.greatest(size, F.lit(1))))
    return time_position(df, time, key).withColumn("block", block.cast("int")).drop("pos", "n")


def detect_strategy(df: DataFrame, target: str, group: str | None = None, time: str | None = None) -> str:
    if time:
        return "time_series"
    row = df.agg(F.count("*").alias("n"), (F.count_distinct(group) + F.max(F.col(group).isNull().cast("int")) if group else F.lit(None)).alias("g"), F.count_distinct(target).alias("u")).first()
    if group and row.g < row.n:
        return "group"
    plain = df.schema[target].dataType.typeName() in ("string", "boolean") or row.u <= max(20, math.floor(0.05 * row.n))
    return "stratified" if plain else "random"


def split_dataset(df: DataFrame, key: str, target: str, strategy: str = "auto", group: str | None = None, time: str | None = None, test_size: float = 0.2) -> DataFrame:
    """df with the column part, by the strategy named or detected."""
    strategy = detect_strategy(df, target, group, time) if strategy == "auto" else strategy
    if strategy == "time_series":
        return time_split(df, time, key, test_size)
    if strategy == "group":
        return group_split(df, group, test_size)
    if strategy == "stratified":
        return stratified_split(df, key, target, test_size)
    if strategy == "random":
        return random_split(df, key, test_size)
    raise ValueError(f"unknown strategy: {strategy}")
