"""Metrics of predictions held in columns. Each is an aggregation by distinct labels or scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.operators.ranges import quantiles, running, with_range


def classification(df: DataFrame, y: str, p: str) -> DataFrame:
    """(accuracy, f1_macro) over the labels that occur in either column."""
    cells = df.groupBy(F.col(y).cast("string").alias("y"), F.col(p).cast("string").alias("p")).agg(F.count("*").alias("n"))
    sides = cells.select("n", F.explode(F.array_distinct(F.array("y", "p"))).alias("label"), "y", "p")
    labels = sides.groupBy("label").agg(F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("y") != F.col("p"), F.col("n")).otherwise(0)).alias("wrong"))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("wrong")), F.lit(0.0))
    # Right predictions of all labels over all rows; a wrong one counts under two labels.
    return labels.agg((F.sum("tp") / (F.sum("tp") + F.sum("wrong") / 2)).alias("accuracy"), F.avg(f1).alias("f1_macro"))


def regression(df: DataFrame, y: str, p: str) -> DataFrame:
    e = F.col(y) - F.col(p)
    return df.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.try_divide(F.sum(e * e), F.count(e) * F.var_pop(F.when(e.isNotNull(), F.col(y))))).alias("r2"))


def roc_auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """(n, n_positive, auc) by average ranks of distinct scores; y is 0 or 1; auc is null for one class."""
    known = with_range(df.where(F.col(y).isNotNull() & F.col(score).isNotNull()).select(F.col(y).alias("y"), F.col(score).alias("s")), "s", "_b")
    counts = known.groupBy("_b", "s").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    ranked = running(counts, ["s"], ["n"]).select("pos", "n", (F.col("upto_n") - (F.col("n") - 1) / 2.0).alias("rank"))
    n, n1 = F.sum("n"), F.sum("pos")
    return ranked.agg(n.alias("n"), n1.alias("n_positive"), F.try_divide(F.sum(F.expr("pos * rank")) - n1 * (n1 + 1) / 2.0, n1 * (n - n1)).alias("auc"))


def roc_auc_classes(df: DataFrame, y: str, scores: str) -> DataFrame:
    """(class, n, n_positive, auc): each class 0, 1, ... against the rest; scores is an array with a score for each class.
    One range count and one running sum for all classes."""
    rows = df.where(F.col(y).isNotNull() & F.col(scores).isNotNull()).select(F.col(y).cast("int").alias("y"), F.posexplode(scores).alias("class", "s")).where("s is not null")
    counts = with_range(rows, "s", "_b").groupBy("class", "_b", "s").agg(F.count_if(F.col("y") == F.col("class")).alias("pos"), F.count("*").alias("n"))
    ranked = running(counts, ["s"], ["n"], ["class"]).select("class", "pos", "n", (F.col("upto_n") - (F.col("n") - 1) / 2.0).alias("rank"))
    n, n1 = F.sum("n"), F.sum("pos")
    return ranked.groupBy("class").agg(n.alias("n"), n1.alias("n_positive"), F.try_divide(F.sum(F.expr("pos * rank")) - n1 * (n1 + 1) / 2.0, n1 * (n - n1)).alias("auc"))


def thresholds(df: DataFrame, y: str, score: str) -> DataFrame:
    """(threshold, precision, recall, f1) at 0.01, 0.02, ... 0.99 for score >= threshold: scores are counted by
    the last threshold they reach, and sums taken from above."""
    step = F.greatest(F.lit(0), F.least(F.lit(99), F.floor(F.round(F.col(score) * 100, 9)).cast("int")))
    counts = df.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.sum(y).alias("pos"))
    full = df.sparkSession.range(100).select(F.col("id").cast("int").alias("step")).join(counts, "step", "left").select("step", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("pos", F.lit(0)).alias("pos"))
    above = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)  # 100 rows
    sums = full.select("step", F.sum("pos").over(above).alias("tp"), F.sum("n").over(above).alias("called"), F.sum("pos").over(Window.partitionBy()).alias("all"))
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return sums.where("step > 0").select(
        (F.col("step") / 100).alias("threshold"), safe(F.col("tp"), F.col("called")).alias("precision"), safe(F.col("tp"), F.col("all")).alias("recall"), safe(2 * F.col("tp"), F.col("called") + F.col("all")).alias("f1")
    )


def best_threshold(df: DataFrame, y: str, score: str, metric: str = "f1") -> float:
    return thresholds(df, y, score).agg(F.max_by("threshold", F.struct(F.col(metric), -F.col("threshold"))).alias("t")).first().t


def baseline_classification(df: DataFrame, y: str) -> DataFrame:
    """(accuracy, f1_macro) of always saying the most frequent class."""
    counts = df.groupBy(y).agg(F.count("*").alias("n"))
    n, top = F.sum("n"), F.max("n")
    return counts.agg((top / n).alias("accuracy"), (2 * top / (n + top) / F.count("*")).alias("f1_macro"))


def baseline_regression(df: DataFrame, y: str) -> DataFrame:
    mean = F.broadcast(df.agg(F.avg(y).alias("_p")))  # one row
    return regression(df.select(y).join(mean), y, "_p")


def segment_errors(df: DataFrame, segment: str, y: str, p: str) -> DataFrame:
    """(segment, n, error_rate), worst first."""
    out = df.groupBy(F.coalesce(F.col(segment).cast("string"), F.lit("nan")).alias("segment")).agg(F.count("*").alias("n"), F.avg((~F.col(y).eqNullSafe(F.col(p))).cast("double")).alias("error_rate"))
    return out.orderBy(F.desc("error_rate"), "segment")


def quartile(df: DataFrame, column: str) -> DataFrame:
    """df with `quartile` 1..4 by right-closed edges at the exact quartiles."""
    q, x = quantiles(df, [column], [0.25, 0.5, 0.75])[column], F.col(f"`{column}`")
    if q is None:
        return df.withColumn("quartile", F.lit(None).cast("int"))
    return df.withColumn("quartile", F.when(x <= q[0], 1).when(x <= q[1], 2).when(x <= q[2], 3).when(x.isNotNull(), 4))


def fold_summary(scores: DataFrame) -> DataFrame:
    """(metric, mean, std) of (fold, metric, value); population deviation."""
    return scores.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def verdict(gap: float, std: float) -> str:
    """Of the mean and deviation over folds of training score less validation score, larger being better."""
    if gap > 0.15 or (gap > 0.10 and std > 0.08):
        return "overfitting"
    return "underfitting" if gap < -0.05 else "good_fit"


def imbalance(df: DataFrame, y: str) -> DataFrame:
    """(n, ratio, strategy): the smallest class over the largest, and what to do about it."""
    counts = df.where(F.col(y).isNotNull()).groupBy(y).agg(F.count("*").alias("n"))
    out = counts.agg(F.sum("n").alias("n"), F.when(F.count("*") < 2, 1.0).otherwise(F.min("n") / F.max("n")).alias("ratio"))
    strategy = F.when(F.col("ratio") >= 0.3, "none").when((F.col("n") >= 200) & (F.col("ratio") * F.col("n") >= 6), "oversample_smote").otherwise("class_weight")
    return out.withColumn("strategy", strategy)


def class_weights(df: DataFrame, y: str) -> DataFrame:
    """(class, weight): n / (classes * count)."""
    counts = df.where(F.col(y).isNotNull()).groupBy(F.col(y).alias("class")).agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    return counts.select("class", (F.sum("n").over(every) / (F.count("*").over(every) * F.col("n"))).alias("weight"))
