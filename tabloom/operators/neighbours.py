"""Mutual information of a number with a category or another number, from distances to the k-th neighbour.

Distinct values are counted first. Neighbours are looked for in stretches of the order of values, which overlap or are asked again
where a nearer one may lie beyond; how many values lie within a distance comes from running counts by ranges of values, where the ends of the intervals are rows that count nothing. So results don't depend on partitions, and no task sees a whole column."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.operators.ranges import running, with_range
from tabloom.sources.tables import store_dir

NEIGHBOURS = 3
#: Values of a stretch of the order.
STRETCH = 2_048


def digamma(x: Column) -> Column:
    """Of whole numbers from 1 on, by recurrence up to 10 and the asymptotic series from there."""
    up = F.greatest(F.lit(0), F.lit(10) - x).cast("int")
    z = (x + up).cast("double")
    series = F.log(z) - 1 / (2 * z) - 1 / (12 * z**2) + 1 / (120 * z**4) - 1 / (252 * z**6) + 1 / (240 * z**8) - 1 / (132 * z**10)
    return series - F.aggregate(F.sequence(F.lit(0), up), F.lit(0.0), lambda s, i: s + F.when(i < up, 1 / (x + i)).otherwise(0.0))


def _end(upper: bool):
    """The last number whose distance from v, as it is computed, is below r; v itself where r is 0."""

    @F.pandas_udf(T.DoubleType())
    def end(v: pd.Series, r: pd.Series) -> pd.Series:
        v, r = v.to_numpy(float), r.to_numpy(float)
        # Between v, which is near, and a number that is not, halved until none is left between. Near 0 numbers lie closer
        # than distances do, so a few steps from v + r on would not do.
        near = v
        far = v + r + 4 * np.spacing(r + np.abs(v)) if upper else v - r - 4 * np.spacing(r + np.abs(v))
        while True:
            middle = near + (far - near) / 2
            open_ = (middle != near) & (middle != far)
            if not open_.any():
                break
            below = np.abs(middle - v) < r
            near, far = np.where(open_ & below, middle, near), np.where(open_ & ~below, middle, far)
        q = near
        return pd.Series(np.where(r > 0, q, v))

    return end


def within(points: DataFrame, values: DataFrame, v: str, r: str, name: str) -> DataFrame:
    """points with `name`: how many rows of the counted `values` (value, n) are nearer than r to v, or equal where r is 0."""
    asked = points.withColumns({"_low": _end(False)(F.col(v), F.col(r)), "_high": _end(True)(F.col(v), F.col(r))})
    ends = [asked.select(F.col(c).alias("value"), F.lit(kind).alias("kind"), F.lit(0).cast("long").alias("n")).distinct() for c, kind in (("_low", 0), ("_high", 2))]
    every = values.select("value", F.lit(1).alias("kind"), "n").union(ends[0]).union(ends[1])
    upto = running(with_range(every, "value", "_b"), ["value", "kind"], ["n"])
    low, high = (upto.where(F.col("kind") == kind).select(F.col("value").alias(c), F.col("upto_n").alias(f"{c}_n")) for c, kind in (("_low", 0), ("_high", 2)))
    return asked.join(low, "_low").join(high, "_high").withColumn(name, F.col("_high_n") - F.col("_low_n")).drop("_low", "_high", "_low_n", "_high_n")


def _counted(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.col(column).alias("value")).agg(F.sum("n").alias("n"))


class _Tables:
    """Tables of steps, written where saved objects lie, so each step is planned and computed once; removed at the end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{store_dir(spark)}/neighbours/{uuid.uuid4().hex}", 0

    def __call__(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.folder}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{self.n}")

    def row(self, out: DataFrame) -> DataFrame:
        rows = out.collect()
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return self.spark.createDataFrame(rows, "n long, mi double")


def of_category(df: DataFrame, number: str, category: str, k: int = NEIGHBOURS) -> DataFrame:
    """(n, mi): of known pairs, without categories of a single row."""
    cut = _Tables(df.sparkSession)
    known = df.select(F.col(f"`{number}`").cast("double").alias("x"), F.col(f"`{category}`").cast("string").alias("g")).where("x is not null and not isnan(x) and g is not null")
    cells = known.groupBy("g", "x").agg(F.count("*").alias("n"))
    sizes = cells.groupBy("g").agg(F.sum("n").alias("size")).where("size > 1")
    cells = cut(cells.join(sizes, "g").withColumn("k", F.least(F.lit(k), F.col("size") - 1).cast("int")))
    # Places of a category's distinct values; k on either side are enough for the k nearest rows.
    placed = running(with_range(cells, "x", "_b").withColumn("_one", F.lit(1).cast("long")), ["x"], ["_one"], ["g"]).withColumn("place", F.col("upto__one") - 1)
    stretch, inside = F.floor(F.col("place") / STRETCH), F.col("place") % STRETCH
    each = F.array(stretch, F.when((inside < k) & (stretch > 0), stretch - 1), F.when(inside >= STRETCH - k, stretch + 1))
    dealt = placed.withColumn("own", stretch).withColumn("stretch", F.explode(F.array_compact(each)))
    near = Window.partitionBy("g", "stretch").orderBy("place").rowsBetween(-k, k)
    dealt = dealt.withColumn("met", F.collect_list(F.struct("x", "n")).over(near)).where("own = stretch")
    apart = F.flatten(F.transform("met", lambda m: F.array_repeat(F.abs(m["x"] - F.col("x")), F.least(m["n"], F.lit(k + 1)).cast("int"))))
    radius = cut(dealt.select("x", "n", "size", "k", F.sort_array(apart)[F.col("k")].alias("r")))  # the first is the row itself
    found = within(radius, _counted(cells, "x"), "x", "r", "m")
    mean = lambda c: F.sum(F.col("n") * digamma(F.col(c))) / F.sum("n")
    out = found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (mean("k") - mean("size") - mean("m")).alias("s")).select("n", F.greatest(F.lit(0.0), digamma(F.greatest("n", F.lit(1))) + F.col("s")).alias("mi"))
    return cut.row(out)


def _nearest(asked: np.ndarray, points: np.ndarray, weight: np.ndarray, k: int, itself: bool) -> np.ndarray:
    """The k smallest distances (the larger of both differences) of rows asked to points, each as often as its weight; with
    `itself`, the asked ones are the points, and one row of each is left out."""
    out = np.full((len(asked), k), np.inf)
    for at in range(0, len(asked), 256):
        some = asked[at : at + 256]
        apart = np.maximum(np.abs(some[:, None, 0] - points[None, :, 0]), np.abs(some[:, None, 1] - points[None, :, 1]))
        times = np.broadcast_to(weight, apart.shape).copy()
        if itself:
            times[np.arange(len(some)), at + np.arange(len(some))] -= 1
            apart[times == 0] = np.inf
        first = np.argpartition(apart, min(k, apart.shape[1]) - 1, axis=1)[:, :k]
        near, n = np.take_along_axis(apart, first, 1), np.take_along_axis(times, first, 1)
        order = np.argsort(near, axis=1)
        near, upto = np.take_along_axis(near, order, 1), np.cumsum(np.take_along_axis(n, order, 1), axis=1)
        for j in range(k):
            place = (upto <= j).sum(axis=1)
            found = np.take_along_axis(near, np.minimum(place, near.shape[1] - 1)[:, None], 1)[:, 0]
            out[at : at + 256, j] = np.where(place < near.shape[1], found, np.inf)
    return out


def _measured(rows: DataFrame, k: int) -> DataFrame:
    """rows (stretch, x, y, n, guest) with near, the k smallest distances to the points of the stretch that are no guests; a point
    that is none leaves out itself once."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one stretch after the other, in one batch each."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            key = batch.column("stretch").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if s < e:
                    if held and held[-1].column("stretch")[0].as_py() != key[s]:
                        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                        held = []
                    held.append(batch.slice(s, e - s))
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole(batches):
            x = np.stack([table.column("x").to_numpy(), table.column("y").to_numpy()], 1)
            n, guest = table.column("n").to_numpy(), table.column("guest").to_numpy(zero_copy_only=False)
            home = np.flatnonzero(~guest)
            for some, itself in ((home, True), (np.flatnonzero(guest), False)):
                if len(some) and len(home):
                    near = _nearest(x[some], x[home], n[home], k, itself)
                    part = table.take(pa.array(some))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near.tolist(), pa.list_(pa.float64()))], names=[*part.schema.names, "near"])

    ordered = rows.select("stretch", "x", "y", "n", "guest").repartition("stretch").sortWithinPartitions("stretch", "guest", "x", "y")
    return ordered.mapInArrow(run, "stretch long, x double, y double, n long, guest boolean, near array<double>")


def unit(deviation: float) -> float:
    """Ten digits of a deviation, which don't depend on the order of adding up; 1 for a constant."""
    return float(f"{deviation:.10g}") or 1.0


def of_numbers(df: DataFrame, a: str, b: str, k: int = NEIGHBOURS) -> DataFrame:
    """(n, mi): of pairs known on both sides; with k rows or fewer, 0. Distances are the larger of both differences, each in
    units of the column's deviation. Points are measured in stretches of their order by (a, b), and again in each other stretch that
    begins or ends nearer than their k-th neighbour so far."""
    pairs = df.select(F.col(f"`{a}`").cast("double").alias("x"), F.col(f"`{b}`").cast("double").alias("y")).where("x is not null and not isnan(x) and y is not null and not isnan(y)")
    facts = pairs.agg(F.count("*").alias("n"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy")).first()
    if facts.n <= k:
        return df.sparkSession.createDataFrame([(facts.n, 0.0)], "n long, mi double")
    cut = _Tables(df.sparkSession)
    cells = cut(pairs.select((F.col("x") / F.lit(unit(facts.sx))).alias("x"), (F.col("y") / F.lit(unit(facts.sy))).alias("y")).groupBy("x", "y").agg(F.count("*").alias("n")))
    # Places in the order of (x, y), by ranges of both.
    ranged = with_range(with_range(cells, "x", "_b"), "y", "_yb")
    before = running(ranged.groupBy("_b", "x", "_yb").agg(F.count("*").alias("m")), ["x", "_yb"], ["m"]).select("x", "_yb", (F.col("upto_m") - F.col("m")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("x", "_yb").orderBy("y"))
    placed = cut(ranged.withColumn("inside", inside).join(before, ["x", "_yb"]).select("x", "y", "n", F.floor((F.col("before") + F.col("inside") - 1) / STRETCH).alias("stretch")))
    home = placed.withColumn("guest", F.lit(False))
    first = cut(_measured(home, k))
    limits = placed.groupBy("stretch").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    last = F.col("near")[k - 1]
    open_ = first.join(limits, "stretch").where((F.col("x") - last <= F.col("low")) | (F.col("x") + last >= F.col("high")))
    open_ = cut(open_.withColumns({"_from": F.col("x") - last, "_to": F.col("x") + last}))
    # Of the stretches in order, those that end before x - r come first and those that begin after x + r last; both are counted by
    # running sums in which the ends of the interval count nothing.
    rows = lambda frame, c, kind, m: frame.select(F.col(c).alias("value"), F.lit(kind).alias("kind"), F.lit(m).cast("long").alias("m"))
    ended = running(with_range(rows(limits, "high", 1, 1).union(rows(open_, "_from", 0, 0).distinct()), "value", "_b"), ["value", "kind"], ["m"]).where("kind = 0").select(F.col("value").alias("_from"), F.col("upto_m").alias("first"))
    begun = running(with_range(rows(limits, "low", 1, 1).union(rows(open_, "_to", 2, 0).distinct()), "value", "_b"), ["value", "kind"], ["m"]).where("kind = 2").select(F.col("value").alias("_to"), (F.col("upto_m") - 1).alias("last"))
    spread = open_.join(ended, "_from").join(begun, "_to").select("x", "y", "n", F.col("stretch").alias("own"), F.explode(F.sequence("first", "last")).alias("stretch")).where("stretch <> own")
    second = _measured(home.unionByName(spread.select("stretch", "x", "y", "n", F.lit(True).alias("guest"))), k).where("guest")
    every = first.select("x", "y", "n", "near").union(second.select("x", "y", "n", "near"))
    radius = cut(every.groupBy("x", "y").agg(F.max("n").alias("n"), F.sort_array(F.flatten(F.collect_list("near")))[k - 1].alias("r")))
    both = cut(within(radius, _counted(cells, "x"), "x", "r", "nx"))
    found = within(both, _counted(cells, "y"), "y", "r", "ny")
    mean = lambda c: F.sum(F.col("n") * digamma(F.col(c))) / F.sum("n")
    out = found.agg(F.sum("n").alias("n"), (mean("nx") + mean("ny")).alias("s")).select("n", F.greatest(F.lit(0.0), digamma(F.col("n")) + digamma(F.lit(k)) - F.col("s")).alias("mi"))
    return cut.row(out)
