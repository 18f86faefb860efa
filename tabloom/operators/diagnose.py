"""Diagnostics of a table: profile, roles, task, missing values, outliers, leakage. Each is one or two
aggregations over all columns at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.columns import corr, outside, skew
from tabloom.operators.ranges import counted, quantiles, quantiles_of, with_codes

TIMED = (T.TimestampType, T.TimestampNTZType, T.DateType, T.StringType)
VOCABULARIES = [["true", "false"], ["yes", "no"], ["0", "1"], ["1", "2"]]


def numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def long_form(df: DataFrame, columns: list[str], kind: str = "double") -> DataFrame:
    """(column, value) rows."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast(kind).alias("value")) for c in columns]
    return df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")


def profile_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row a column: n, missing, n_unique, min, max, mean, std, skew, kurtosis, q1, median, q3. Moments come from
    one aggregation of rows, the rest from the counts of values."""
    columns = columns or numeric(df)
    parts = []
    for c in columns:
        x = F.col(f"`{c}`").cast("double")
        parts.append(F.struct(
            F.lit(c).alias("column"), F.count("*").alias("n"), (F.count("*") - F.count(x)).alias("missing"), F.min(x).alias("min"), F.max(x).alias("max"),
            F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), skew(x).alias("skew"), F.kurtosis(x).alias("kurtosis"),
        ))
    moments = df.agg(F.array(*parts).alias("all")).select(F.inline("all"))
    counts = quantiles_of(counted(df, columns), [0.25, 0.5, 0.75]).select("column", "n_unique", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    joined = moments.join(F.broadcast(counts), "column", "left")  # a row for each column
    return joined.select("column", "n", "missing", F.coalesce("n_unique", F.lit(0)).alias("n_unique"), "min", "max", "mean", "std", "skew", "kurtosis", "q1", "median", "q3")


def profile_dataset(df: DataFrame, depth: str = "full") -> DataFrame:
    """One row a column of any type: column, dtype, missing_pct; numbers (booleans as 0 and 1) have min, max, mean,
    std and skew, times their first, last and frequency, strings and booleans their cardinality. depth "full" adds
    kurtosis and normality_stat, normality_p and is_normal (null below eight values), and the ten most frequent
    values of strings as top_values; "quick" leaves these null."""
    if depth not in ("full", "quick"):
        raise ValueError(f"unknown depth: {depth}")
    from tabloom.operators.associate import normality

    kinds = {f.name: f.dataType for f in df.schema}
    flags = [c for c, k in kinds.items() if isinstance(k, T.BooleanType)]
    numbers = numeric(df) + flags
    words = [c for c, k in kinds.items() if isinstance(k, (T.StringType, T.CharType, T.VarcharType))] + flags
    times = [c for c, k in kinds.items() if isinstance(k, (T.TimestampType, T.TimestampNTZType, T.DateType))]
    number = lambda c: F.col(f"`{c}`").cast("int").cast("double") if c in flags else F.col(f"`{c}`").cast("double")
    none = F.lit(None).cast("double")
    rows = []
    for c, kind in kinds.items():
        x = number(c) if c in numbers else none
        made = {"min": F.min(x), "max": F.max(x), "mean": F.avg(x), "std": F.stddev_samp(x), "skew": skew(x), "kurtosis": F.kurtosis(x)} if c in numbers else dict.fromkeys(["min", "max", "mean", "std", "skew", "kurtosis"], none)
        if depth == "quick":
            made["kurtosis"] = none
        ends = [f(F.col(f"`{c}`").cast("timestamp")) if c in times else F.lit(None).cast("timestamp") for f in (F.min, F.max)]
        rows.append(F.struct(F.lit(c).alias("column"), F.lit(kind.simpleString()).alias("dtype"), (100 * F.avg(F.col(f"`{c}`").isNull().cast("double"))).alias("missing_pct"), *(v.alias(k) for k, v in made.items()), ends[0].alias("first"), ends[1].alias("last")))
    out = df.agg(F.array(*rows).alias("all")).select(F.inline("all"))
    if times:
        made = df.sparkSession.createDataFrame([(c, frequency(df, c)) for c in times], "column string, frequency string")
        out = out.join(F.broadcast(made), "column", "left")
    else:
        out = out.withColumn("frequency", F.lit(None).cast("string"))
    if words:
        counts = distinct_values(df, words).groupBy("column").agg(F.count("value").alias("cardinality"))
        out = out.join(F.broadcast(counts), "column", "left").withColumn("cardinality", F.when(F.col("column").isin(words), F.coalesce("cardinality", F.lit(0))))
    else:
        out = out.withColumn("cardinality", F.lit(None).cast("long"))
    if depth == "full" and numbers:
        tested = normality(df.select(*(number(c).alias(c) for c in numbers)), numbers).select("column", F.col("k2").alias("normality_stat"), F.col("p_value").alias("normality_p"), F.when(F.col("n") >= 8, F.col("is_normal")).alias("is_normal"))
        out = out.join(F.broadcast(tested), "column", "left")
    else:
        out = out.withColumns({"normality_stat": none, "normality_p": none, "is_normal": F.lit(None).cast("boolean")})
    kind = "array<struct<value:string,count:bigint>>"
    if depth == "full" and words:
        ranked = top_values(df, words).groupBy("column").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "value", "count"))), lambda x: F.struct(x["value"].alias("value"), x["count"].alias("count"))).alias("top_values"))
        return out.join(F.broadcast(ranked), "column", "left")
    return out.withColumn("top_values", F.lit(None).cast(kind))


def top_values(df: DataFrame, columns: list[str], k: int = 10) -> DataFrame:
    """The k most frequent known values of each column; ties by value."""
    counts = long_form(df, columns, "string").where("value is not null").groupBy("column", "value").agg(F.count("*").alias("count"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("count"), "value"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def datetime_range(df: DataFrame, column: str) -> DataFrame:
    """min, max and the one step between neighbouring distinct times in seconds (null if steps differ)."""
    times = df.select(F.col(f"`{column}`").cast("timestamp").alias("t")).where("t is not null").distinct()
    # Days are windows of their own; the step across days joins each day's last time to the next day's first.
    day = Window.partitionBy(F.to_date("t")).orderBy("t")
    steps = times.select("t", (F.unix_micros("t") - F.unix_micros(F.lag("t").over(day))).alias("step"))
    within = steps.agg(F.min("t").alias("min"), F.max("t").alias("max"), F.min("step").alias("a"), F.max("step").alias("b"), F.count("*").alias("n"))
    days = times.groupBy(F.to_date("t").alias("d")).agg(F.min("t").alias("first"), F.max("t").alias("last"))
    between = days.select((F.unix_micros("first") - F.unix_micros(F.lag("last").over(Window.orderBy("d")))).alias("s")).agg(F.min("s").alias("c"), F.max("s").alias("e"))
    least, most = F.least("a", "c"), F.greatest("b", "e")
    return within.crossJoin(F.broadcast(between)).select("min", "max", F.when((F.col("n") >= 3) & (least == most), least / 1e6).alias("step_seconds"))


def frequency(df: DataFrame, column: str) -> str | None:
    """The alias of the one step between neighbouring distinct times: s, min, h, D, W-<day> or a multiple, or MS, ME,
    QS, QE, YS, YE where all times are the first or last days of consecutive months, quarters or years. None otherwise,
    or below three times."""
    found = datetime_range(df, column).first()
    if found.step_seconds:
        step = found.step_seconds
        if step % 604_800 == 0:
            return f"{int(step // 604_800) if step > 604_800 else ''}W-{found.min.strftime('%a').upper()}"
        size, alias = next(((s, a) for s, a in ((86_400, "D"), (3_600, "h"), (60, "min"), (1, "s")) if step % s == 0), (None, None))
        return None if size is None else f"{int(step // size) if step > size else ''}{alias}"
    t = F.col(f"`{column}`").cast("timestamp")
    midnight = t == F.date_trunc("day", t)
    month = F.year(t) * 12 + F.month(t)
    row = df.where(t.isNotNull()).agg(F.every(midnight & (F.dayofmonth(t) == 1)).alias("first"), F.every(midnight & (F.to_date(t) == F.last_day(t))).alias("last"), F.min(month).alias("a"), F.max(month).alias("b"), F.count_distinct(month).alias("n"), F.count_distinct(t).alias("u"), F.count_distinct(month % 3).alias("q"), F.count_distinct(month % 12).alias("y")).first()
    if row.n < 3 or row.u != row.n or not (row.first or row.last):
        return None
    steps, rest = divmod(row.b - row.a, row.n - 1)
    alias = {1: "M", 3: "Q", 12: "Y"}.get(steps) if rest == 0 else None
    fits = alias == "M" or (alias == "Q" and row.q == 1) or (alias == "Y" and row.y == 1)
    return alias + ("S" if row["first"] else "E") if fits else None


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n): how often each value occurs, nulls too; long ones are known by a digest. One shuffle for
    all columns, of counts that were summed up before it."""
    short = lambda s: F.when(F.length(s) > 64, F.sha2(s, 256)).otherwise(s)
    pairs = [F.struct(F.lit(c).alias("column"), short(F.col(f"`{c}`").cast("string")).alias("value")) for c in columns]
    return df.select(F.inline(F.array(*pairs))).groupBy("column", "value").agg(F.count("*").alias("n"))


def _dated(df: DataFrame, columns: list[str]) -> dict[str, bool]:
    """Whether the first 50 known values of each string column all are dates or times."""
    if not columns:
        return {}
    first = [df.select(F.lit(c).alias("column"), F.col(f"`{c}`").alias("s")).where("s is not null").limit(50) for c in columns]
    fits = F.col("s").rlike(r"^\d{4}-\d{2}-\d{2}([ T].*)?$") & F.try_to_timestamp("s").isNotNull()
    return {r.column: r.fits for r in reduce(DataFrame.union, first).groupBy("column").agg(F.every(fits).alias("fits")).collect()}


def column_roles(df: DataFrame) -> DataFrame:
    """(column, role, confidence, n_unique, missing) by the first rule that fits: constant, datetime, boolean,
    identifier, then numbers by the number and share of distinct values, strings by that share and their length."""
    strings = [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.CharType, T.VarcharType))]
    dated = _dated(df, strings)
    kinds = {}
    for f in df.schema:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            kinds[f.name] = "time"
        elif isinstance(f.dataType, T.NumericType):
            kinds[f.name] = "number"
        elif isinstance(f.dataType, T.BooleanType):
            kinds[f.name] = "boolean"
        elif f.name in strings:
            kinds[f.name] = "dated" if dated.get(f.name) else "string"
        else:
            kinds[f.name] = "other"
    lengths = df.agg(F.array(*(F.struct(F.lit(c).alias("column"), (F.avg(F.length(f"`{c}`")) if c in strings else F.lit(None).cast("double")).alias("len"), F.lit(k).alias("kind")) for c, k in kinds.items())).alias("all")).select(F.inline("all"))
    low = F.lower("value")
    boolean = reduce(lambda a, b: a | b, [F.coalesce(F.every(low.isin(v)), F.lit(False)) for v in VOCABULARIES])
    facts = distinct_values(df, df.columns).groupBy("column").agg(F.count("value").alias("u"), F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"), boolean.alias("b"))
    # A row for each column; an empty table has no values.
    rows = lengths.join(F.broadcast(facts), "column", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("u", "n", "missing")})
    u, n, kind = F.col("u"), F.col("n"), F.col("kind")
    share = u / F.greatest(n - F.col("missing"), F.lit(1))
    says = lambda role, sure: F.struct(F.lit(role).alias("role"), F.lit(sure).alias("confidence"))
    role = F.when(u <= 1, says("constant", "high")).when(kind == "time", says("datetime", "high")).when(kind == "dated", says("datetime", "medium"))
    role = role.when(kind == "boolean", says("boolean", "high")).when((u == 2) & F.coalesce("b", F.lit(False)), says("boolean", "medium")).when(u > 0.95 * n, says("identifier", "high"))
    role = role.when((kind == "number") & ((u > 20) | (share > 0.05)), says("numeric_continuous", "high")).when(kind == "number", says("numeric_discrete", "medium"))
    role = role.when((kind == "string") & (share > 0.5) & (F.col("len") > 30), says("text_freeform", "medium"))
    role = role.when((kind == "string") & (u <= 50), says("categorical_nominal", "high")).when(kind == "string", says("categorical_nominal", "medium"))
    return rows.withColumn("r", role.otherwise(says("unknown", "low"))).select("column", "r.role", "r.confidence", u.alias("n_unique"), "missing")


def infer_target(columns: list[str], goal: str, target: str | None = None) -> str:
    """The column the goal names last; without one, the last column."""
    if target:
        return target
    named = [c for c in columns if c.lower() in goal.lower()]
    return max(named, key=lambda c: goal.lower().rfind(c.lower())) if named else columns[-1]


def infer_task(df: DataFrame, target: str) -> DataFrame:
    """(target, n_unique, task, confidence, needs_clarification)"""
    kind, unique = df.schema[target].dataType, F.count_distinct(F.col(f"`{target}`"))
    says = lambda t, c, ask: F.struct(F.lit(t).alias("task"), F.lit(c).alias("confidence"), F.lit(ask).alias("needs_clarification"))
    if not isinstance(kind, T.NumericType):
        answer = says("classification", "high", False)
    else:
        fraction = isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType))
        few = says("classification", "medium", True) if fraction else says("classification", "high", False)
        answer = F.when(unique <= 2, few).when(unique <= 20, says("regression", "low", True) if fraction else says("classification", "high", False))
        answer = answer.otherwise(says("regression", "high", False))
    return df.agg(F.lit(target).alias("target"), unique.alias("n_unique"), answer.alias("a")).select("target", "n_unique", "a.*")


def class_balance(df: DataFrame, target: str) -> DataFrame:
    counts = df.where(F.col(target).isNotNull()).groupBy(F.col(target).cast("string").alias("value")).agg(F.count("*").alias("count"))
    return counts.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy()))


def missingness(df: DataFrame) -> DataFrame:
    """Of each column with missing values: their share and the largest |r| between its null mask and another column:
    numbers as they are, strings and booleans as the codes of their sorted values (null: -1)."""
    rows = []
    for c in df.columns:
        mask = F.col(f"`{c}`").isNull().cast("double")
        others = [F.abs(corr(mask, F.col(f"`{o}`"))) for o in numeric(df) if o != c]
        rows.append(F.struct(F.lit(c).alias("column"), (F.count("*") - F.count(F.col(f"`{c}`"))).alias("missing"), (100 * F.avg(mask)).alias("missing_pct"), F.greatest(*others, F.lit(0.0), F.lit(0.0)).alias("max_abs_r")))
    out = df.agg(F.array(*rows).alias("all")).select(F.inline("all")).where("missing > 0")
    texts = [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.CharType, T.VarcharType, T.BooleanType))]
    if texts and (gaps := [r.column for r in out.select("column").collect()]):
        by_code = _mask_by_code(df, texts, gaps)
        out = out.join(F.broadcast(by_code), "column", "left").select("column", "missing", "missing_pct", F.greatest("max_abs_r", "_r").alias("max_abs_r"))
    return out.withColumn("likely_mar", F.col("max_abs_r") >= 0.3)


def _mask_by_code(df: DataFrame, texts: list[str], gaps: list[str]) -> DataFrame:
    """(column, _r) of each of the columns gaps: the largest |r| of its null mask with the codes of another one of texts."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in texts]
    masks = [F.col(f"`{g}`").isNull().cast("long").alias(f"_m{i}") for i, g in enumerate(gaps)]
    values = df.select(F.explode(F.array(*pairs)).alias("p"), *masks).groupBy("p.column", "p.value").agg(F.count("*").alias("_n"), *(F.sum(f"_m{i}").alias(f"_m{i}") for i in range(len(gaps))))
    x = F.col("code").cast("double")
    n, m = F.sum("_n").cast("double"), F.sum(x * F.col("_n"))
    spread = F.sum(x * x * F.col("_n")) - m * m / n
    found = []
    for i, g in enumerate(gaps):
        k = F.sum(f"_m{i}").cast("double")
        r = F.when(F.count("*") > 1, F.abs(F.try_divide(F.sum(x * F.col(f"_m{i}")) - m * k / n, F.sqrt(spread * (k - k * k / n)))))
        found.append(F.struct(F.lit(g).alias("gap"), r.alias("_r")))
    each = with_codes(values).groupBy("column").agg(F.array(*found).alias("all")).select("column", F.inline("all"))
    return each.where("column <> gap").groupBy(F.col("gap").alias("column")).agg(F.max("_r").alias("_r"))


def outliers(df: DataFrame, columns: list[str], method: str = "iqr", key: str | None = None) -> DataFrame:
    """(column, lower, upper, n_outliers) by Tukey's fence or by three standard deviations; with a key also examples,
    the smallest five keys of rows outside."""
    if method not in ("iqr", "zscore"):
        raise ValueError(f"unknown method: {method}")
    if method == "iqr":
        q = quantiles(df, columns, [0.25, 0.75])
        rows = [(c, q[c][0] - 1.5 * (q[c][1] - q[c][0]), q[c][1] + 1.5 * (q[c][1] - q[c][0])) if q[c] else (c, None, None) for c in columns]
        bounds = df.sparkSession.createDataFrame(rows, "column string, lower double, upper double")
    else:
        x = {c: F.col(f"`{c}`").cast("double") for c in columns}
        rows = [F.struct(F.lit(c).alias("column"), *(F.when(F.stddev_samp(x[c]) > 0, F.avg(x[c]) + k * F.stddev_samp(x[c])).alias(n) for k, n in ((-3, "lower"), (3, "upper")))) for c in columns]
        bounds = df.agg(F.array(*rows).alias("all")).select(F.inline("all"))
    bounds = F.broadcast(bounds)  # a row for each column
    keys = [F.col(f"`{key}`").alias("_key")] if key else []
    pairs = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns]
    hits = df.select(F.explode(F.array(*pairs)).alias("p"), *keys).select("p.*", *(["_key"] if key else [])).join(bounds, "column").where(outside(F.col("value"), F.col("lower"), F.col("upper")))
    out = bounds.join(hits.groupBy("column").agg(F.count("*").alias("n")), "column", "left").select("column", "lower", "upper", F.coalesce("n", F.lit(0)).alias("n_outliers"))
    if not key:
        return out
    first = hits.withColumn("_r", F.row_number().over(Window.partitionBy("column").orderBy("_key"))).where("_r <= 5").groupBy("column").agg(F.sort_array(F.collect_list("_key")).alias("examples"))
    return out.join(F.broadcast(first), "column", "left")


def _time(df: DataFrame, column: str) -> Column:
    x = F.col(f"`{column}`")
    return F.try_to_timestamp(x) if isinstance(df.schema[column].dataType, T.StringType) else x


def leakage(df: DataFrame, target: str, outcome_time: str | None = None, threshold: float = 0.98) -> DataFrame:
    """(column, unique_ratio, abs_r, after_outcome, suspects) for every other column. Strings are compared with the
    outcome's time where they can be read as a time."""
    rows, numbers = [], numeric(df)
    tested = [c for c in df.columns if c not in (target, outcome_time)]
    for c in tested:
        r = F.abs(corr(F.col(f"`{c}`"), F.col(f"`{target}`"))) if c in numbers and target in numbers else F.lit(None).cast("double")
        timed = outcome_time and isinstance(df.schema[c].dataType, TIMED)
        after = F.avg(F.coalesce((_time(df, c) > _time(df, outcome_time)).cast("double"), F.lit(0.0))) if timed else F.lit(None).cast("double")
        rows.append(F.struct(F.lit(c).alias("column"), r.alias("r"), after.alias("after"), F.count("*").alias("n")))
    facts = df.agg(F.array(*rows).alias("all")).select(F.inline("all"))
    unique = distinct_values(df, tested).groupBy("column").agg(F.count("value").alias("u"))
    ratio = F.round(F.coalesce("u", F.lit(0)) / F.col("n"), 4)
    why = F.array_compact(F.array(F.when(ratio > 0.95, "identifier_like"), F.when(F.col("r") >= threshold, "high_correlation"), F.when(F.col("after") > 0.5, "timestamped_after_outcome")))
    joined = facts.join(F.broadcast(unique), "column", "left")  # a row for each column
    return joined.select("column", ratio.alias("unique_ratio"), F.round("r", 4).alias("abs_r"), F.round("after", 4).alias("after_outcome"), F.array_join(why, ",").alias("suspects"))
