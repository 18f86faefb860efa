"""Associations and tests between columns. Ranks and distributions are taken over counts of distinct values, in
ranges of values, so no task sees a whole column; tables of categories are never filled up to a grid."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.columns import corr, finite
from tabloom.functions.tails import (
    FEW_BOUND, FEW_DEVIATION, FEW_MEAN, MANY_DEVIATION, MANY_MEAN, WEIGHT_NEXT, WEIGHT_OUTER,
    chi_square_tail, f_tail, ks_p_value, ks_tail, ks_tail_of, normal_quantile, normal_tail, normality_z, polynomial, t_tail,
)
from tabloom.operators.ranges import average_ranks, counted, quantiles, running, with_range


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    both = df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).where("a is not null and b is not null")
    pairs = both.groupBy("a", "b").agg(F.count("*").alias("n"))
    ra, rb = average_ranks(both, "a").toDF("a", "ra"), average_ranks(both, "b").toDF("b", "rb")
    ranked = pairs.join(ra, "a").join(rb, "b")
    n, sa, sb = F.sum("n"), F.sum(F.expr("n * ra")), F.sum(F.expr("n * rb"))
    cov = F.sum(F.expr("n * ra * rb")) - sa * sb / n
    va, vb = F.sum(F.expr("n * ra * ra")) - sa * sa / n, F.sum(F.expr("n * rb * rb")) - sb * sb / n
    rho = F.when((n >= 2) & (va > 0) & (vb > 0), cov / F.sqrt(va * vb)).otherwise(F.lit(0.0))
    return ranked.agg(F.coalesce(n, F.lit(0)).alias("n"), rho.alias("rho"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) of the cells of known values that occur."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def _with_totals(cells: DataFrame) -> DataFrame:
    """cells with the totals ra and cb of their row and column."""
    rows, columns = (cells.groupBy(c).agg(F.sum("n").alias(t)) for c, t in (("a", "ra"), ("b", "cb")))
    return cells.join(rows, "a").join(columns, "b")


def chi_square(cells: DataFrame) -> DataFrame:
    """(n, r, k, chi2) of the cells that occur; Yates's correction for 2 x 2. An absent cell adds its expectation e,
    and all expectations add up to n, so absent ones need no rows."""
    rows, columns = (cells.groupBy(c).agg(F.sum("n").alias("m")) for c in ("a", "b"))
    sides = rows.agg(F.sum("m").alias("t"), F.count("*").cast("int").alias("r"), F.sum(1.0 / F.col("m")).alias("ir")).join(F.broadcast(columns.agg(F.count("*").cast("int").alias("k"), F.sum(1.0 / F.col("m")).alias("ic"))))
    e = F.col("ra") * F.col("cb") / F.col("t")
    off = F.col("n") - e
    found = _with_totals(cells).join(F.broadcast(sides.select("t"))).agg(F.sum(off * off / e).alias("x"), F.sum(e).alias("e"), F.max(F.abs(off)).alias("off"))
    # In a 2 x 2 table all cells are equally far off, and 1 / e adds up to n times the sums of 1 / total.
    yates = F.pow(F.greatest(F.col("off") - 0.5, F.lit(0.0)), 2) * F.col("t") * F.col("ir") * F.col("ic")
    plain = F.col("x") + F.greatest(F.col("t") - F.col("e"), F.lit(0.0))
    chi2 = F.when((F.col("r") == 2) & (F.col("k") == 2), yates).otherwise(plain)
    return sides.join(F.broadcast(found)).select(F.col("t").alias("n"), "r", "k", chi2.alias("chi2"))  # one row each


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    least = F.least(F.col("r"), F.col("k")) - 1
    v = F.when(least > 0, F.sqrt(F.col("chi2") / (F.col("n") * least))).otherwise(F.lit(0.0))
    return chi_square(contingency(df, a, b)).withColumn("v", v)


def anova(df: DataFrame, category: str, value: str) -> DataFrame:
    """(k, n, f, eta2); the total sum of squares takes rows without a category too."""
    x = F.col(value).cast("double")
    groups = df.groupBy(F.col(category).alias("g")).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v")).where("n > 0")
    known = F.col("g").isNotNull()
    grand = F.sum(F.expr("n * m")) / F.sum("n")
    # Sums of squares from the moments of the groups.
    total = F.sum(F.expr("n * (v + m * m)")) - F.sum("n") * grand * grand
    n, k = F.sum(F.when(known, F.col("n"))), F.count(F.when(known, 1))
    sm = F.sum(F.when(known, F.expr("n * m")))
    within, between_all = F.sum(F.when(known, F.expr("n * v"))), F.sum(F.when(known, F.expr("n * m * m")))
    inner = between_all - sm * sm / n  # about the mean of rows with a category, for F
    outer = between_all - 2 * grand * sm + n * grand * grand  # about the mean of all rows, for eta2
    return groups.agg(k.alias("k"), n.alias("n"), F.try_divide(inner / (k - 1), within / (n - k)).alias("f"), F.try_divide(outer, total).alias("eta2"))


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """Plug-in estimate in nats over known pairs."""
    n, t = F.col("n"), F.col("t")
    cells = _with_totals(contingency(df, a, b)).select("n", (n * F.log(n / (F.col("ra") * F.col("cb")))).alias("x"))
    return cells.agg(F.sum("n").alias("t"), F.sum("x").alias("x")).select((F.col("x") / t + F.log(t)).alias("mi"))


def ks_two_samples(df: DataFrame, value: str, first: str) -> DataFrame:
    """(n1, n2, d): first is a boolean column that tells the samples apart."""
    known = with_range(df.where(F.col(value).isNotNull()).select(F.col(value).alias("v"), F.col(first).alias("f")), "v", "_b")
    counts = known.groupBy("_b", "v").agg(F.count_if("f").alias("a"), F.count_if(~F.col("f")).alias("b"))
    steps = running(counts, ["v"], ["a", "b"])
    return steps.agg(F.max("all_a").alias("n1"), F.max("all_b").alias("n2"), F.max(F.abs(F.try_divide("upto_a", "all_a") - F.try_divide("upto_b", "all_b"))).alias("d"))


def shift(df: DataFrame, value: str, first: str, alpha: float = 0.05, exact: bool = True) -> DataFrame:
    """(n1, n2, d, p_value, shifted): whether the two samples of value come from different distributions. The p-value is exact for
    samples of up to EXACT_ROWS values each, unless `exact` is false, and that of Kolmogorov's limit for larger ones."""
    d, n1, n2 = F.col("d"), F.col("n1"), F.col("n2")
    found = ks_two_samples(df, value, first).withColumn("p_value", ks_p_value(d, n1, n2) if exact else ks_tail(d, n1.cast("double"), n2))
    return found.withColumn("shifted", F.col("p_value") < alpha)


def shift_categories(df: DataFrame, value: str, first: str) -> DataFrame:
    """(n1, n2, k, chi2) of the table of the known categories of value by sample; 0 for fewer than two categories."""
    cells = contingency(df.select(F.col(f"`{value}`").cast("string").alias("v"), F.col(first).cast("int").alias("f")), "f", "v")
    sizes = cells.agg(F.coalesce(F.sum(F.when(F.col("a") == 1, F.col("n"))), F.lit(0)).alias("n1"), F.coalesce(F.sum(F.when(F.col("a") == 0, F.col("n"))), F.lit(0)).alias("n2"))
    return chi_square(cells).join(F.broadcast(sizes)).select("n1", "n2", "k", F.when((F.col("k") < 2) | (F.col("r") < 2), 0.0).otherwise(F.col("chi2")).alias("chi2"))  # one row each


def validate_split(df: DataFrame, part: str = "part", target: str | None = None, force: bool = False, alpha: float = 0.05) -> DataFrame | None:
    """(column, test, statistic, p_value, flagged) of every column but the target: whether its values in the train and the
    test part come from different distributions, by the two-sample distance of numbers (booleans are 0 and 1) or
    chi-square of categories, rounded to four digits. A column without values in a part has the test null and is not
    flagged. None, without force, where train has more than 1,000 rows. One test a column; the results are one row each."""
    rows = df.withColumn("_first", F.col(part) == "train")
    if not force and rows.where("_first").limit(1_001).count() > 1_000:
        return None
    out = []
    for c in (c for c in df.columns if c not in (part, target)):
        kind = df.schema[c].dataType
        if isinstance(kind, (T.NumericType, T.BooleanType)):
            x = F.col(f"`{c}`")
            r = ks_two_samples(rows.select((x.cast("int") if isinstance(kind, T.BooleanType) else x).cast("double").alias("v"), "_first"), "v", "_first").first()
            found = ("ks", r.d, ks_tail_of(r.d, r.n1, r.n2)) if r.n1 and r.n2 else None
        else:
            r = shift_categories(rows, c, "_first").first()
            found = ("chi_square", r.chi2, chi_square_tail(r.chi2, r.k - 1) if r.k > 1 else 1.0) if r.n1 and r.n2 else None
        out.append((c, found[0], round(found[1], 4), round(found[2], 4), found[2] < alpha) if found else (c, None, None, None, False))
    return df.sparkSession.createDataFrame(out, "column string, test string, statistic double, p_value double, flagged boolean")


def normality(df: DataFrame, columns: list[str], alpha: float = 0.05) -> DataFrame:
    """(column, n, k2, p_value, is_normal) by D'Agostino and Pearson's test, all columns in one aggregation.
    With fewer than 8 values, or equal ones, k2 and p_value are null and is_normal is false."""
    rows = []
    for c in columns:
        x = finite(F.col(f"`{c}`").cast("double"))
        rows.append(F.struct(F.lit(c).alias("column"), F.count(x).alias("n"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurtosis"), F.stddev_pop(x).alias("std")))
    moments = df.agg(F.array(*rows).alias("all")).select(F.inline("all"))
    # Null instead of n keeps untested columns out of formulas that divide by n - 3 and less.
    tested = moments.select("column", F.col("n").alias("count"), F.when(F.expr("n >= 8 and std > 0"), F.col("n").cast("double")).alias("n"), "skew", "kurtosis")
    tested = normality_z(tested).withColumn("k2", F.col("z1") * F.col("z1") + F.col("z2") * F.col("z2")).withColumn("p_value", F.exp(-F.col("k2") / 2))
    return tested.select("column", F.col("count").alias("n"), "k2", "p_value", F.coalesce(F.col("p_value") > alpha, F.lit(False)).alias("is_normal"))


#: Columns with fewer known values are tested by Shapiro and Wilk's W.
FEW_VALUES = 5_000


def shapiro_wilk(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, w, p_value) of the columns with 3 to FEW_VALUES - 1 known values, all in one pass: W is the squared correlation of
    the values with weights made from the normal scores of their ranks, by Royston's approximation (AS R94), as is the
    p-value. Equal values share out the scores of their ranks. Where all values are equal, w is 1 and p_value 1."""
    rows = df.select(*(finite(F.col(f"`{c}`").cast("double")).alias(c) for c in columns))
    ranked = running(counted(rows, columns), ["value"], ["n"], ["column"])
    few = ranked.where((F.col("all_n") >= 3) & (F.col("all_n") < FEW_VALUES))
    at = few.select("column", "value", F.col("all_n").cast("double").alias("size"), F.explode(F.sequence(F.col("upto_n") - F.col("n") + 1, F.col("upto_n"))).alias("i"))
    z = normal_quantile((F.col("i") - 0.375) / (F.col("size") + 0.25))
    at = at.withColumn("z", z).withColumn("outer", F.when(F.col("size") > 5, 2).otherwise(1))
    inner = (F.col("i") > F.col("outer")) & (F.col("i") <= F.col("size") - F.col("outer"))
    value = lambda i: F.max(F.when(F.col("i") == i, F.col("value")))
    score = lambda i: F.max(F.when(F.col("i") == i, F.col("z")))
    n = F.col("size")
    sums = at.groupBy("column", "size").agg(
        F.sum(F.col("z") * F.col("z")).alias("zz"), F.sum(F.when(inner, F.col("z") * F.col("value"))).alias("zx"), F.var_pop("value").alias("v"),
        (value(n) - value(F.lit(1))).alias("d1"), (value(n - 1) - value(F.lit(2))).alias("d2"), score(n).alias("z1"), score(n - 1).alias("z2"),
    )
    root = 1 / F.sqrt(n)
    a = sums.withColumn("a1", F.when(n > 3, F.col("z1") / F.sqrt("zz") + polynomial(root, WEIGHT_OUTER)).otherwise(F.sqrt(F.lit(0.5))))
    a = a.withColumn("a2", F.when(n > 5, F.col("z2") / F.sqrt("zz") + polynomial(root, WEIGHT_NEXT)).otherwise(F.lit(0.0)))
    left = F.when(n > 5, F.col("zz") - 2 * F.col("z1") * F.col("z1") - 2 * F.col("z2") * F.col("z2")).otherwise(F.col("zz") - 2 * F.col("z1") * F.col("z1"))
    share = 1 - 2 * F.col("a1") * F.col("a1") - 2 * F.col("a2") * F.col("a2")
    top = F.col("a1") * F.col("d1") + F.col("a2") * F.col("d2") + F.when(n > 3, F.coalesce("zx", F.lit(0.0)) / F.sqrt(left / share)).otherwise(F.lit(0.0))
    w = F.when(F.col("v") > 0, F.least(F.lit(1.0), top * top / (n * F.col("v")))).otherwise(F.lit(1.0))
    found = a.withColumn("w", w).withColumn("y", F.log(F.greatest(1 - F.col("w"), F.lit(1e-300))))
    bound, log_n = polynomial(n, FEW_BOUND), F.log(n)
    few_z = (-F.log(F.greatest(bound - F.col("y"), F.lit(1e-300))) - polynomial(n, FEW_MEAN)) / F.exp(polynomial(n, FEW_DEVIATION))
    many_z = (F.col("y") - polynomial(log_n, MANY_MEAN)) / F.exp(polynomial(log_n, MANY_DEVIATION))
    three = F.greatest(F.lit(0.0), 6 / math.pi * (F.asin(F.sqrt("w")) - F.asin(F.sqrt(F.lit(0.75)))))
    found = found.withColumn("tail", normal_tail(F.when(n <= 11, few_z).otherwise(many_z)))
    p = F.when(F.col("v") <= 0, 1.0).when(n == 3, three).when((n <= 11) & (F.col("y") >= bound), 0.0).otherwise(F.col("tail"))
    return found.select("column", F.col("size").cast("long").alias("n"), "w", p.alias("p_value"))


def normality_test(df: DataFrame, columns: list[str], alpha: float = 0.05) -> DataFrame:
    """(column, n, test, statistic, p_value, is_normal): shapiro_wilk below FEW_VALUES known values, from there on the test of skewness and
    kurtosis; with fewer than three values no test, and not normal."""
    few = shapiro_wilk(df, columns).select("column", F.col("w").alias("statistic"), "p_value", F.lit("shapiro_wilk").alias("test"))
    many = normality(df, columns).where(F.col("n") >= FEW_VALUES).select("column", F.col("k2").alias("statistic"), "p_value", F.lit("skewness_kurtosis").alias("test"))
    sizes = normality(df, columns).select("column", "n")
    out = sizes.join(F.broadcast(few.union(many)), "column", "left")  # a row a column
    return out.select("column", "n", "test", "statistic", "p_value", F.coalesce(F.col("p_value") > alpha, F.lit(False)).alias("is_normal"))


def f_scores(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(column, f) of univariate regression on the target."""
    rows = []
    for c in features:
        r, n = corr(F.col(c), F.col(target)), F.count(F.when(F.col(c).isNotNull() & F.col(target).isNotNull(), 1))
        rows.append(F.struct(F.lit(c).alias("column"), F.try_divide(r * r * (n - 2), 1 - r * r).alias("f")))
    return df.agg(F.array(*rows).alias("all")).select(F.inline("all"))


def associate(df: DataFrame, a: str, b: str, a_numeric: bool, b_numeric: bool, weak: float = 0.1) -> dict:
    """The measure that fits both kinds, and mutual information too where it is weaker than `weak`."""
    p_value = None  # where the test is not defined
    if a_numeric and b_numeric:
        found = spearman(df, a, b).first()
        method, strength = "spearman", abs(found.rho)
        if found.n > 2:
            p_value = t_tail(found.rho * ((found.n - 2) / (1 - found.rho**2)) ** 0.5, found.n - 2) if strength < 1 else 0.0
    elif a_numeric or b_numeric:
        x, g = (a, b) if a_numeric else (b, a)
        found = anova(df, g, x).first()
        method, strength = "anova", (found.eta2 or 0.0) ** 0.5
        if found.f is not None:
            p_value = f_tail(found.f, found.k - 1, found.n - found.k)
    else:
        found = cramers_v(df, a, b).first()
        method, strength = "cramers_v", found.v or 0.0
        if found.n and min(found.r, found.k) > 1:
            p_value = chi_square_tail(found.chi2, (found.r - 1) * (found.k - 1))
    out = {"method": method, "strength": strength, "p_value": p_value, "escalated_to_mi": strength < weak}
    if strength < weak:
        binned = df
        for c, number in ((a, a_numeric), (b, b_numeric)):
            if number:
                edges = quantiles(df, [c], [i / 10 for i in range(1, 10)])[c]
                x = F.col(c)
                below = sum((F.lit(e) < x).cast("int") for e in edges or [])
                binned = binned.withColumn(c, below if edges else F.lit(None).cast("int"))
        out["mutual_information"] = mutual_information(binned, a, b).first().mi
    return out
