"""Features, imputation, encoding, scaling, outliers: each fits on training rows by one aggregation and
is applied as column expressions or a join with a small fitted table."""

from __future__ import annotations

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.columns import clip, part_of_date, signed_log
from tabloom.functions.expressions import arithmetic
from tabloom.operators.ranges import median_by, quantiles, running, with_codes, with_range

AGGREGATES = {
    "mean": F.avg, "sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "median": F.median, "std": F.stddev_samp, "var": F.var_samp, "nunique": F.count_distinct,
}
#: Fitted tables of at most so many rows are broadcast; larger ones are joined by shuffle.
SMALL_TABLE = 100_000


def small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.limit(SMALL_TABLE + 1).count() <= SMALL_TABLE else table


def row_feature(df: DataFrame, name: str, definition: dict) -> DataFrame:
    kind = definition["kind"]
    if kind == "datetime_part":
        return df.withColumn(name, part_of_date(definition["part"], F.col(f"`{definition['column']}`")))
    if kind == "ratio":
        return df.withColumn(name, F.try_divide(F.col(f"`{definition['numerator']}`").cast("double"), F.col(f"`{definition['denominator']}`")))
    if kind == "arithmetic":
        return df.withColumn(name, arithmetic(definition["expression"], df.columns))
    raise ValueError(f"unknown kind: {kind}")


def derive(df: DataFrame, definitions: list[dict], train: DataFrame | None = None) -> DataFrame:
    """Definitions one after the other; aggregations are fitted on train (default: df)."""
    for d in definitions:
        if d["expression_type"] == "row_wise":
            df = row_feature(df, d["name"], d["definition"])
            train = row_feature(train, d["name"], d["definition"]) if train is not None else None
        elif d["expression_type"] == "aggregation":
            x = d["definition"]
            df = group_feature(train if train is not None else df, df, d["name"], x["group_by"], x["value_column"], x.get("agg", "mean"))
        else:
            raise ValueError(f"unknown expression_type: {d['expression_type']}")
    return df


def fit_group_feature(train: DataFrame, keys: list[str], value: str, agg: str = "mean") -> tuple[DataFrame, object]:
    """(_<key>, ..., _v) of train's groups, and the value over all of train. A median is taken from counted values by ranges, so
    no task holds all values of a group or of the table."""
    if agg not in AGGREGATES:
        raise ValueError(f"unknown aggregate: {agg}")
    named = train.select(*(F.col(f"`{k}`").alias(f"_{k}") for k in keys), F.col(f"`{value}`").alias("_x"))
    by = [f"_{k}" for k in keys]
    if agg == "median":
        known = named.withColumn("_x", F.col("_x").cast("double"))
        found = median_by(known, by, "_x")
        # Groups without known values have none.
        fitted = named.select(*by).distinct().join(found, [F.col(f"`{k}`").eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(by)], "left").select(*by, "_v")
        q = quantiles(known, ["_x"], [0.5])["_x"]
        return fitted, q[0] if q else None
    return named.groupBy(*by).agg(AGGREGATES[agg]("_x").alias("_v")), named.agg(AGGREGATES[agg]("_x").alias("_v")).first()._v


def apply_group_feature(rows: DataFrame, table: DataFrame, rest: object, name: str, keys: list[str]) -> DataFrame:
    same = [F.col(f"`{k}`") == F.col(f"`_{k}`") for k in keys]
    filled = F.coalesce("_v", F.lit(rest)) if rest is not None else F.col("_v")
    return rows.join(table, same, "left").withColumn(name, filled).drop("_v", *(f"_{k}" for k in keys))


def group_feature(train: DataFrame, rows: DataFrame, name: str, keys: list[str], value: str, agg: str = "mean") -> DataFrame:
    """rows with the aggregate of value by keys over train; keys that train lacks get the one over all of train."""
    fitted, rest = fit_group_feature(train, keys, value, agg)
    return apply_group_feature(rows, small(fitted), rest, name, keys)


def fit_impute(train: DataFrame, strategies: dict[str, str]) -> dict[str, object]:
    """The value that stands for null in each column: mean, median, most_frequent (ties: the smallest), constant (0 or
    __missing__); model_based is the mean of a single column, and drop_rows falls back to the median or mode. One job
    for all means, one for all medians and one for all modes."""
    text = {c: train.schema[c].dataType.typeName() in ("string", "boolean") for c in strategies}
    how = {c: ("most_frequent" if text[c] else "median") if s == "drop_rows" else "mean" if s == "model_based" else s for c, s in strategies.items()}
    if unknown := set(how.values()) - {"mean", "median", "most_frequent", "constant"}:
        raise ValueError(f"unknown strategy: {unknown.pop()}")
    of = lambda s: [c for c in how if how[c] == s]
    fill: dict[str, object] = {c: "__missing__" if text[c] else 0.0 for c in of("constant")}
    if of("mean"):
        row = train.agg(*(F.avg(f"`{c}`").alias(f"_{i}") for i, c in enumerate(of("mean")))).first()
        fill |= dict(zip(of("mean"), row, strict=True))
    if of("median"):
        fill |= {c: q[0] if q else None for c, q in quantiles(train, of("median"), [0.5]).items()}
    if modes := of("most_frequent"):
        sides = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value"), (F.lit(0.0) if text[c] else F.col(f"`{c}`").cast("double")).alias("order")) for c in modes]
        counts = train.select(F.inline(F.array(*sides))).where("value is not null").groupBy("column", "value", "order").agg(F.count("*").alias("n"))
        fill |= {r.column: r.value for r in counts.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), F.col("order"), F.col("value"))).alias("value")).collect()}
    return {c: fill.get(c) for c in strategies}


def apply_impute(rows: DataFrame, fill: dict[str, object]) -> DataFrame:
    filled = {}
    for c, v in fill.items():
        kind = rows.schema[c].dataType
        wide = "double" if isinstance(v, float) and kind.typeName() in ("byte", "short", "integer", "long", "float") else kind
        filled[c] = F.coalesce(F.col(f"`{c}`").cast(wide), F.lit(v).cast(wide))
    return rows.withColumns(filled)


def impute(train: DataFrame, rows: DataFrame, strategies: dict[str, str]) -> DataFrame:
    """rows without nulls in the columns named, by the values fitted on train."""
    return apply_impute(rows, fit_impute(train, strategies))


def auto_impute(role: str, likely_mar: bool, missing_pct: float) -> str | None:
    if role not in ("numeric_continuous", "numeric_discrete", "categorical_nominal", "categorical_ordinal", "boolean"):
        return None
    if missing_pct >= 60:
        return "drop_rows"
    return ("model_based" if likely_mar else "median") if role.startswith("numeric") else "constant"


def auto_encode(cardinality: int) -> str:
    return "one_hot" if cardinality <= 15 else "target_encoding"


def lookup(rows: DataFrame, fitted: DataFrame, column: str, value: str, name: str, otherwise: Column) -> DataFrame:
    """rows with name: fitted's value of the row's category; nulls are a category."""
    right = small(fitted.select(F.col(column).alias("_c"), F.col(value).alias("_v"), F.lit(True).alias("_hit")))
    return rows.join(right, F.col(column).eqNullSafe(F.col("_c")), "left").withColumn(name, F.when(F.col("_hit"), F.col("_v")).otherwise(otherwise)).drop("_c", "_v", "_hit")


def encode_frequency(train: DataFrame, rows: DataFrame, column: str, name: str) -> DataFrame:
    counts = train.groupBy(column).agg(F.count("*").alias("_n"))
    shares = counts.join(F.broadcast(train.agg(F.count("*").alias("_all")))).select(column, (F.col("_n") / F.col("_all")).alias("_share"))  # one row
    return lookup(rows, shares, column, "_share", name, F.lit(0.0))


def label_codes(train: DataFrame, column: str) -> DataFrame:
    """(column, _code): 0, 1, ... in the order of the known categories."""
    known = train.select(F.col(f"`{column}`").alias("value")).where("value is not null").distinct()
    if train.schema[column].dataType.typeName() == "string":
        codes = with_codes(known.select(F.lit(column).alias("column"), "value"))
    else:
        codes = running(with_range(known, "value", "_b").withColumn("_one", F.lit(1).cast("long")), ["value"], ["_one"]).withColumn("code", F.col("upto__one") - 1)
    return codes.select(F.col("value").alias(column), F.col("code").cast("int").alias("_code"))


def encode_label(train: DataFrame, rows: DataFrame, column: str, name: str) -> DataFrame:
    """0, 1, ... in the order of the categories; unknown ones and nulls -1."""
    return lookup(rows, label_codes(train, column), column, "_code", name, F.lit(-1))


def encode_one_hot(train: DataFrame, rows: DataFrame, column: str, most: int = 1_000) -> DataFrame:
    """A 0/1 column for each category of train; unknown ones have only zeros. A table of more than `most` columns is
    refused, as Spark plans each column by itself; encode_one_hot_vector has no such bound."""
    found = [r[0] for r in train.select(F.col(f"`{column}`")).where(F.col(f"`{column}`").isNotNull()).distinct().orderBy(F.col(f"`{column}`")).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} categories: use encode_one_hot_vector")
    return rows.withColumns({f"{column}_{v}": F.coalesce((F.col(f"`{column}`") == F.lit(v)).cast("int"), F.lit(0)) for v in found})


def encode_one_hot_vector(train: DataFrame, rows: DataFrame, column: str, name: str) -> DataFrame:
    """One sparse vector column for any number of categories, in their order; unknown ones and nulls have only zeros."""
    codes = label_codes(train, column)
    size = codes.count()
    out = lookup(rows, codes, column, "_code", "_at", F.lit(-1)).withColumn("_at", F.when(F.col("_at") < 0, size).otherwise(F.col("_at")).cast("double"))
    # Categories 0 .. size, of which the last one, for unknown values, has no slot.
    every = rows.sparkSession.range(size + 1).select(F.col("id").cast("double").alias("_at"))
    return OneHotEncoder(inputCol="_at", outputCol=name, dropLast=True).fit(every).transform(out).drop("_at")


def encode_target(train: DataFrame, rows: DataFrame, column: str, target: str, name: str, smoothing: float = 10.0) -> DataFrame:
    every = F.avg(target).alias("_all")
    stats = train.groupBy(column).agg(F.sum(target).alias("_s"), F.count(target).alias("_m")).join(F.broadcast(train.agg(every)))
    stats = stats.select(column, ((F.col("_s") + smoothing * F.col("_all")) / (F.col("_m") + smoothing)).alias("_enc"))
    out = rows.join(F.broadcast(train.agg(every)))  # one row
    return lookup(out, stats, column, "_enc", name, F.col("_all")).drop("_all")


def encode_target_out_of_fold(rows: DataFrame, column: str, target: str, name: str, fold: str = "fold", smoothing: float = 10.0) -> DataFrame:
    """Each row by the other folds: sums of its category less those of its own fold; one aggregation."""
    cells = rows.groupBy(column, fold).agg(F.sum(target).alias("_s"), F.count(target).alias("_m"))
    total = Window.partitionBy(column)
    cells = cells.select(F.col(column).alias("_c"), F.col(fold).alias("_f"), (F.sum("_s").over(total) - F.col("_s")).alias("_s"), (F.sum("_m").over(total) - F.col("_m")).alias("_m"))
    out = rows.join(F.broadcast(rows.agg(F.avg(target).alias("_all")))).join(small(cells), F.col(column).eqNullSafe(F.col("_c")) & (F.col(fold) == F.col("_f")))
    encoded = F.when(F.col("_m") > 0, (F.col("_s") + smoothing * F.col("_all")) / (F.col("_m") + smoothing)).otherwise(F.col("_all"))
    return out.withColumn(name, encoded).drop("_c", "_f", "_s", "_m", "_all")


def fit_scale(train: DataFrame, columns: list[str], method: str = "standard") -> dict[str, tuple[float, float]]:
    """(centre, width) of each column: standard (population deviation), minmax or robust. The width of a constant
    column is 1, so it becomes 0; a column without known values has no entry."""
    if method == "robust":
        q = quantiles(train, columns, [0.25, 0.5, 0.75])
        found = {c: (v[1], v[2] - v[0]) for c, v in q.items() if v}
    elif method in ("standard", "minmax"):
        fits = []
        for i, c in enumerate(columns):
            x = F.col(f"`{c}`").cast("double")
            fits += [(F.avg(x) if method == "standard" else F.min(x)).alias(f"_c{i}"), (F.stddev_pop(x) if method == "standard" else F.max(x) - F.min(x)).alias(f"_w{i}")]
        row = train.agg(*fits).first()
        found = {c: (row[f"_c{i}"], row[f"_w{i}"]) for i, c in enumerate(columns) if row[f"_c{i}"] is not None}
    else:
        raise ValueError(f"unknown method: {method}")
    return {c: (centre, width or 1.0) for c, (centre, width) in found.items()}


def apply_scale(rows: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    return rows.withColumns({c: (F.col(f"`{c}`") - F.lit(centre)) / F.lit(width) for c, (centre, width) in fitted.items()})


def scale(train: DataFrame, rows: DataFrame, columns: list[str], method: str = "standard") -> DataFrame:
    """rows with the columns scaled as fitted on train."""
    return rows if method == "none" else apply_scale(rows, fit_scale(train, columns, method))


def scaler_method(method: str = "auto", family: str | None = None) -> str:
    """auto is none for tree ensembles and standard otherwise."""
    if method == "auto":
        return "none" if family == "tree_ensemble" else "standard"
    if method not in ("standard", "minmax", "robust", "none"):
        raise ValueError(f"unknown method: {method}")
    return method


def fit_outliers(train: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Tukey's fences of each column with known values."""
    q = quantiles(train, columns, [0.25, 0.75])
    return {c: (v[0] - 1.5 * (v[1] - v[0]), v[1] + 1.5 * (v[1] - v[0])) for c, v in q.items() if v}


def apply_outliers(rows: DataFrame, bounds: dict[str, tuple[float, float]], strategy: str) -> DataFrame:
    for c, (lower, upper) in bounds.items():
        x = F.col(f"`{c}`")
        if strategy == "cap":
            rows = rows.withColumn(c, clip(x, F.lit(lower), F.lit(upper)))
        elif strategy == "remove":
            rows = rows.where(x.isNull() | x.between(lower, upper))
        elif strategy == "transform":
            rows = rows.withColumn(c, signed_log(x))
        else:
            raise ValueError(f"unknown strategy: {strategy}")
    return rows


def handle_outliers(train: DataFrame, rows: DataFrame, columns: list[str], strategy: str = "cap") -> DataFrame:
    """cap, remove (rows; nulls stay) or transform, by Tukey's fences of train."""
    if strategy == "transform":
        return rows.withColumns({c: signed_log(F.col(f"`{c}`")) for c in columns})
    if strategy not in ("cap", "remove"):
        raise ValueError(f"unknown strategy: {strategy}")
    return apply_outliers(rows, fit_outliers(train, columns), strategy)
