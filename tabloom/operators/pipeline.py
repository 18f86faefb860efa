"""Preprocessing that is fitted anew on the training rows of every fold: derive, outliers, impute, scale or encode, select.

A Spec only says what to do. fit_spec() learns from training rows, by a few aggregations over all columns at once, a
Fitted, which turns any rows into a vector column. What it learns are bounded facts (a few numbers a column) and, for
encoders, a table of one row a category, which is joined."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, UnivariateFeatureSelector, VectorAssembler, VectorSlicer
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.columns import corr
from tabloom.operators import prepare
from tabloom.operators.diagnose import distinct_values, numeric
from tabloom.sources.tables import handle

NUMERIC_ROLES = ("numeric_continuous", "numeric_discrete")
CATEGORY_ROLES = ("categorical_nominal", "categorical_ordinal", "boolean")
ROLES = (*NUMERIC_ROLES, *CATEGORY_ROLES, "datetime", "text_freeform", "identifier", "constant", "unknown")
FEATURES = "_features"
#: Folds in which a training row's own target is kept out of its target encoding.
ENCODING_FOLDS = 5


@dataclass(frozen=True)
class Spec:
    """What to do to which column. Without imputers and encoders all numeric columns pass as they are; else columns
    named in neither are left out. outliers: (strategy, columns). selection: (method, share or number, task)."""

    imputers: dict[str, str] = field(default_factory=dict)
    encoders: dict[str, str] = field(default_factory=dict)
    scaler: str = "none"
    outliers: tuple[str, list[str]] | None = None
    derived: list[dict] = field(default_factory=list)
    selection: tuple[str, float | int, str] | None = None
    smoothing: float = 10.0

    @property
    def name(self) -> str:
        return handle(json.dumps(asdict(self), sort_keys=True))


def derived_spec(definitions: list[dict]) -> tuple[list[dict], dict[str, int]]:
    """The definitions, checked, and how many there are of each type."""
    counts = {"row_wise": 0, "aggregation": 0}
    for d in definitions:
        if d.get("expression_type") not in counts:
            raise ValueError(f"unknown expression_type: {d.get('expression_type')}")
        counts[d["expression_type"]] += 1
    return list(definitions), counts


def train_roles(train: DataFrame, target: str) -> dict[str, str]:
    """Roles for preparation: numbers and booleans by their number and share of values, times, identifiers, categories."""
    columns = [c for c in train.columns if c != target]
    unique = {r.column: r.u for r in distinct_values(train, columns).groupBy("column").agg(F.count("value").alias("u")).collect()}
    n = max(1, train.count())
    roles = {}
    for c in columns:
        kind, u = train.schema[c].dataType, unique.get(c, 0)
        if isinstance(kind, (T.NumericType, T.BooleanType)):
            roles[c] = NUMERIC_ROLES[not (u > 20 or u / n > 0.05)]
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            roles[c] = "datetime"
        elif isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
            roles[c] = "identifier" if u / n > 0.95 else "categorical_nominal"
        else:
            roles[c] = "unknown"
    return roles


def missing_flags(train: DataFrame) -> dict[str, tuple[float, bool]]:
    """(percent missing, whether its mask goes with another number: |r| >= 0.3) of each column; strings don't count here."""
    rows = []
    for c in train.columns:
        mask = F.col(f"`{c}`").isNull().cast("double")
        others = [F.abs(corr(mask, F.col(f"`{o}`"))) for o in numeric(train) if o != c]
        rows.append(F.struct(F.lit(c).alias("column"), (100 * F.avg(mask)).alias("pct"), F.coalesce(F.greatest(*others, F.lit(0.0), F.lit(0.0)) >= 0.3, F.lit(False)).alias("mar")))
    return {r.column: (r.pct or 0.0, r.mar) for r in train.agg(F.array(*rows).alias("all")).select(F.inline("all")).collect()}


def imputer_spec(train: DataFrame, target: str, strategies: dict[str, str] | str | None = "auto") -> dict[str, str]:
    """A strategy a column: by role and missing share; a map from roles overrides these, a map from columns is taken as it is."""
    if isinstance(strategies, dict) and not (strategies and set(strategies) <= set(ROLES)):
        return dict(strategies)
    if strategies not in ("auto", None) and not isinstance(strategies, dict):
        raise ValueError(f"unknown strategies: {strategies!r}")
    flags, out = missing_flags(train), {}
    for c, role in train_roles(train, target).items():
        pct, mar = flags[c]
        chosen = (strategies or {}).get(role) if isinstance(strategies, dict) else None
        chosen = chosen or prepare.auto_impute(role, mar, pct)
        if chosen:
            out[c] = chosen
    return out


def encoder_spec(train: DataFrame, target: str, strategy: dict[str, str] | str | None = "auto") -> dict[str, str]:
    """An encoder for each category column: one_hot up to 15 categories and target_encoding above; a name is for all of
    them, a map goes by column, then by role."""
    roles = {c: r for c, r in train_roles(train, target).items() if r in CATEGORY_ROLES}
    if isinstance(strategy, dict):
        return {c: strategy.get(c, strategy.get(r, "one_hot")) for c, r in roles.items()}
    if strategy not in ("auto", None):
        return dict.fromkeys(roles, strategy)
    if not roles:
        return {}
    sizes = {r.column: r.u for r in distinct_values(train, list(roles)).groupBy("column").agg(F.count("value").alias("u")).collect()}
    return {c: prepare.auto_encode(sizes.get(c, 0)) for c in roles}


def outlier_spec(train: DataFrame, target: str, strategy: str = "cap") -> tuple[str, list[str]]:
    """The numeric columns with four known values or more."""
    if strategy not in ("cap", "remove", "transform"):
        raise ValueError(f"unknown strategy: {strategy}")
    columns = [c for c in numeric(train) if c != target]
    known = train.agg(*(F.count(f"`{c}`").alias(f"_{i}") for i, c in enumerate(columns))).first() if columns else ()
    return strategy, [c for c, n in zip(columns, known, strict=True) if n >= 4]


def selection_spec(features: int, task: str, method: str = "auto", keep: float | int = 0.8) -> tuple[str, float | int, str]:
    if method not in ("auto", "filter", "embedded", "wrapper"):
        raise ValueError(f"unknown method: {method}")
    return ("embedded" if features > 50 else "filter") if method == "auto" else method, keep, task


def kept_number(keep: float | int, features: int) -> int:
    """A share (float) or number (int) of features; at least one."""
    if isinstance(keep, float) and 0 < keep <= 1:
        return max(1, round(features * keep))
    return max(1, min(keep, features)) if isinstance(keep, int) else max(1, round(features * 0.8))


def auto_spec(train: DataFrame, target: str, family: str | None = None, **parts: object) -> Spec:
    """Imputers, encoders and scaler chosen from the training rows; `parts` are further fields of the Spec."""
    return Spec(**{"imputers": imputer_spec(train, target), "encoders": encoder_spec(train, target), "scaler": prepare.scaler_method("auto", family)} | parts)


def fixed(table: DataFrame) -> DataFrame:
    """A fitted table that is not computed again by each use: local rows up to SMALL_TABLE of them, else persisted until
    Fitted.release()."""
    some = table.limit(prepare.SMALL_TABLE + 1).toArrow()
    if some.num_rows > prepare.SMALL_TABLE:
        return table.persist()
    return F.broadcast(table.sparkSession.createDataFrame(some, table.schema) if some.num_rows else table.sparkSession.createDataFrame([], table.schema))


def _join(rows: DataFrame, table: DataFrame, column: str, name: str, otherwise) -> DataFrame:
    """rows with name: the value _v of table's row (_c, _v) of the category in column."""
    return rows.join(table.withColumn("_hit", F.lit(True)), F.col(f"`{column}`") == F.col("_c"), "left").withColumn(name, F.when(F.col("_hit"), F.col("_v")).otherwise(otherwise)).drop("_c", "_v", "_hit")


@dataclass
class Step:
    """What one step learnt: facts that JSON can hold and, for some kinds, a table. Steps with `training` are for training rows only."""

    kind: str
    facts: dict
    table: DataFrame | None = None
    training: bool = False

    def apply(self, rows: DataFrame) -> DataFrame:
        return _APPLY[self.kind](rows, self.facts, self.table)


def _apply_impute(rows: DataFrame, facts: dict, table: DataFrame | None) -> DataFrame:
    cast = {c: F.col(f"`{c}`").cast(kind) for c, kind in facts["cast"].items()}
    return prepare.apply_impute(rows.withColumns(cast) if cast else rows, {c: v for c, v in facts["fill"].items() if v is not None})


def _hash_fold(keys: list[str]):
    return F.pmod(F.xxhash64(*(F.col(f"`{k}`") for k in keys)), F.lit(ENCODING_FOLDS)).cast("int")


def _apply_own(rows: DataFrame, facts: dict, table: DataFrame) -> DataFrame:
    """The target encoding of training rows, each by the folds other than its own."""
    name, c = facts["name"], facts["column"]
    joined = rows.withColumn("_mine", _hash_fold(facts["keys"])).join(table, (F.col(f"`{c}`") == F.col("_c")) & (F.col("_mine") == F.col("_q")), "left")
    return joined.withColumn(f"{name}_own", F.coalesce("_v", F.lit(facts["otherwise"]))).drop("_c", "_q", "_v", "_mine")


def _apply_one_hot(rows: DataFrame, facts: dict, table: DataFrame) -> DataFrame:
    """A slot a category; unknown ones have the code `size`, whose slot is dropped."""
    size = float(facts["size"])
    codes = rows.sparkSession.createDataFrame([(size,)], "_at double")
    hot = OneHotEncoder(inputCol="_at", outputCol=facts["name"], dropLast=True).fit(codes)
    return hot.transform(_join(rows, table, facts["column"], "_at", F.lit(size))).drop("_at")


#: How each kind of step turns rows, from what it learnt.
_APPLY = {
    "row_feature": lambda rows, facts, table: prepare.row_feature(rows, facts["name"], facts["definition"]),
    "group_feature": lambda rows, facts, table: prepare.apply_group_feature(rows, table, facts["rest"], facts["name"], facts["keys"]),
    "outliers": lambda rows, facts, table: prepare.apply_outliers(rows, facts["bounds"], facts["strategy"]),
    "impute": _apply_impute,
    "scale": lambda rows, facts, table: prepare.apply_scale(rows, facts["widths"]),
    "lookup": lambda rows, facts, table: _join(rows, table, facts["column"], facts["name"], F.lit(facts["otherwise"])),
    "own": _apply_own,
    "one_hot": _apply_one_hot,
}


class Fitted(Model, MLWritable, MLReadable):
    """What fit_spec learnt: steps, inputs of the vector, slots of it that are kept (None: all). names are the features, as far as
    categories are few enough to be listed. It can be a stage of a PipelineModel, and is saved with its tables as Parquet."""

    def __init__(self, spec: Spec | None = None, target: str = ""):
        super().__init__()
        self.spec, self.target = spec or Spec(), target
        self.steps: list[Step] = []
        self.names: list[str] = []
        self.inputs: list[str] = []
        self.slots: list[int] | None = None
        #: In the training rows a target encoding takes the place of that of the other rows.
        self.own: dict[str, str] = {}

    def add(self, step: Step, train: DataFrame) -> DataFrame:
        self.steps.append(step)
        return step.apply(train)

    def transform(self, rows: DataFrame, params: dict | None = None, training: bool = False) -> DataFrame:
        """rows, all of them, with the vector column FEATURES. With training, rows that fit_spec took as outliers go,
        and target encodings leave out the folds of the row."""
        out = rows
        for step in self.steps:
            if training or not step.training:
                out = step.apply(out)
        inputs = [self.own.get(c, c) if training else c for c in self.inputs]
        out = VectorAssembler(inputCols=inputs, outputCol=FEATURES if self.slots is None else "_all", handleInvalid="keep").transform(out)
        made = [c for c in out.columns if c.startswith("_f_")]
        if self.slots is not None:
            out = VectorSlicer(inputCol="_all", outputCol=FEATURES, indices=self.slots).transform(out).drop("_all")
        return out.drop(*made)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.transform(dataset)

    def columns_of(self, slots: list[int]) -> list[str]:
        return [self.names[i] for i in slots]

    def release(self) -> None:
        """Let go of tables that `fixed` keeps."""
        for step in self.steps:
            if step.table is not None and step.table.is_cached:
                step.table.unpersist()

    def write(self) -> MLWriter:
        return _FittedWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _FittedReader()


class _FittedWriter(MLWriter):
    def __init__(self, fitted: Fitted):
        super().__init__()
        self.fitted = fitted

    def saveImpl(self, path: str) -> None:
        fitted, spark = self.fitted, self.sparkSession
        steps = [{"kind": s.kind, "facts": s.facts, "training": s.training, "table": s.table is not None} for s in fitted.steps]
        facts = {"spec": asdict(fitted.spec), "target": fitted.target, "steps": steps, "names": fitted.names, "inputs": fitted.inputs, "slots": fitted.slots, "own": fitted.own}
        DefaultParamsWriter.saveMetadata(fitted, path, spark, extraMetadata={"preparation": facts})
        for k, step in enumerate(fitted.steps):
            if step.table is not None:
                step.table.write.parquet(f"{path}/tables/{k}")


class _FittedReader(MLReader):
    def load(self, path: str) -> Fitted:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        facts = metadata["preparation"]
        spec = facts["spec"] | {k: tuple(facts["spec"][k]) for k in ("outliers", "selection") if facts["spec"][k]}
        fitted = Fitted(Spec(**spec), facts["target"])
        fitted._resetUid(metadata["uid"])
        fitted.names, fitted.inputs, fitted.slots, fitted.own = (facts[k] for k in ("names", "inputs", "slots", "own"))
        for k, s in enumerate(facts["steps"]):
            table = prepare.small(self.sparkSession.read.parquet(f"{path}/tables/{k}")) if s["table"] else None
            fitted.steps.append(Step(s["kind"], s["facts"], table, s["training"]))
        return fitted


class Preparation(Estimator):
    """fit_spec as a stage of a pyspark.ml Pipeline."""

    def __init__(self, spec: Spec, target: str):
        super().__init__()
        self.spec, self.target = spec, target

    def _fit(self, dataset: DataFrame) -> Fitted:
        return fit_spec(self.spec, dataset, self.target)


def _encode(fitted: Fitted, train: DataFrame, c: str, how: str, smoothing: float) -> DataFrame:
    """train with the feature _f_<c>; the step is added to fitted."""
    name, target = f"_f_{c}", fitted.target
    x, y = F.col(f"`{c}`"), F.col(f"`{target}`")
    if how == "frequency":
        counts = train.groupBy(x.alias("_c")).agg(F.count("*").alias("_n"))
        table = fixed(counts.join(F.broadcast(train.agg(F.count("*").alias("_all")))).select("_c", (F.col("_n") / F.col("_all")).alias("_v")))
        fitted.names.append(c)
        return fitted.add(Step("lookup", {"column": c, "name": name, "otherwise": 0.0}, table), train)
    if how == "target_encoding":
        keys = sorted(k for k in train.columns if not k.startswith("_f_"))
        sums = [F.sum(y.cast("double")).alias("_s"), F.count(y).alias("_m")]
        whole = train.agg(F.avg(y.cast("double"))).first()[0] or 0.0
        smooth = F.try_divide(F.col("_s") + smoothing * whole, F.col("_m") + smoothing)
        table = fixed(train.groupBy(x.alias("_c")).agg(*sums).select("_c", smooth.alias("_v")))
        cells = train.select(x.alias("_c"), _hash_fold(keys).alias("_p"), y.cast("double").alias("y")).groupBy("_c", "_p").agg(F.sum("y").alias("_s"), F.count("y").alias("_m"))
        total = cells.groupBy("_c").agg(F.sum("_s").alias("_ts"), F.sum("_m").alias("_tm"))
        # The other folds of a category: its sums less those of the own fold.
        others = fixed(cells.join(total, "_c").select("_c", "_p", (F.col("_ts") - F.coalesce("_s", F.lit(0.0))).alias("_s"), (F.col("_tm") - F.col("_m")).alias("_m")).select("_c", F.col("_p").alias("_q"), smooth.alias("_v")))
        fitted.own[name] = f"{name}_own"
        fitted.names.append(c)
        train = fitted.add(Step("own", {"column": c, "name": name, "keys": keys, "otherwise": whole}, others, training=True), train)
        return fitted.add(Step("lookup", {"column": c, "name": name, "otherwise": whole}, table), train)
    if how not in ("label", "one_hot"):
        raise ValueError(f"unknown encoder: {how}")
    codes = prepare.label_codes(train, c).select(F.col(f"`{c}`").alias("_c"), F.col("_code").cast("double").alias("_v"))
    size = codes.count()
    table = fixed(codes)
    if how == "label":
        fitted.names.append(c)
        return fitted.add(Step("lookup", {"column": c, "name": name, "otherwise": -1.0}, table), train)
    fitted.names += [f"{c}_{v}" for v in ([str(r[0]) for r in codes.orderBy("_v").limit(1_000).collect()] if size <= 1_000 else map(str, range(size)))]
    return fitted.add(Step("one_hot", {"column": c, "name": name, "size": size}, table), train)


def _selector(train: DataFrame, target: str, names: list[str], selection: tuple[str, float | int, str]):
    """The slots of _all that are kept; None if there is nothing to choose from."""
    method, keep, task = selection
    n = len(names)
    if n <= 1:
        return None
    most = kept_number(keep, n)
    if method == "filter":
        kind = "continuous" if task == "regression" else "categorical"
        chooser = UnivariateFeatureSelector(featuresCol="_all", outputCol=FEATURES, labelCol=target, selectionMode="numTopFeatures").setFeatureType("continuous").setLabelType(kind).setSelectionThreshold(most)
        slots = sorted(chooser.fit(train).selectedFeatures)
    else:
        trees = 200 if method == "embedded" else 100
        forest = lambda col: (RandomForestRegressor if task == "regression" else RandomForestClassifier)(labelCol=target, featuresCol=col, numTrees=trees, seed=42)
        if method == "embedded":
            weight = forest("_all").fit(train).featureImportances.toArray()
            middle = sorted(weight)[n // 2] if n % 2 else (sorted(weight)[n // 2 - 1] + sorted(weight)[n // 2]) / 2
            slots = sorted(sorted((i for i in range(n) if weight[i] >= middle), key=lambda i: (-weight[i], i))[:most])
        else:
            slots = list(range(n))
            while len(slots) > most:
                part = VectorSlicer(inputCol="_all", outputCol="_part", indices=slots).transform(train)
                weight = forest("_part").fit(part).featureImportances.toArray()
                slots.pop(min(range(len(slots)), key=lambda i: (weight[i], i)))
    return slots or list(range(n))


def fit_spec(spec: Spec, train: DataFrame, target: str) -> Fitted:
    """Fits spec on train, which has the target; rows given to transform need not have it."""
    fitted = Fitted(spec, target)
    for d in spec.derived:
        train = fitted.add(_derive_step(d, train), train)
    if spec.outliers and spec.outliers[1]:
        strategy, columns = spec.outliers
        bounds = dict.fromkeys(columns, (0.0, 0.0)) if strategy == "transform" else prepare.fit_outliers(train, columns)
        train = fitted.add(Step("outliers", {"bounds": bounds, "strategy": strategy}, training=strategy == "remove"), train)
    if not spec.imputers and not spec.encoders:
        fitted.inputs = [c for c in numeric(train) if c != target]
        fitted.names = list(fitted.inputs)
    else:
        numbers = [c for c in spec.imputers if c not in spec.encoders]
        strategies = {c: spec.imputers[c] for c in numbers} | {c: spec.imputers.get(c, "constant") for c in spec.encoders}
        strategies = {c: {"mode": "most_frequent"}.get(s, s) for c, s in strategies.items()}
        cast = {c: "string" for c in strategies if c in spec.encoders} | {c: "double" for c in numbers if isinstance(train.schema[c].dataType, T.BooleanType)}
        fill = prepare.fit_impute(train.withColumns({c: F.col(f"`{c}`").cast(kind) for c, kind in cast.items()}) if cast else train, strategies)
        train = fitted.add(Step("impute", {"cast": cast, "fill": fill}), train)
        if spec.scaler != "none" and numbers:
            train = fitted.add(Step("scale", {"widths": prepare.fit_scale(train, numbers, spec.scaler)}), train)
        fitted.names = list(numbers)
        for c, how in spec.encoders.items():
            train = _encode(fitted, train, c, how, spec.smoothing)
        fitted.inputs = [*numbers, *(f"_f_{c}" for c in spec.encoders)]
    if spec.selection:
        inputs = [fitted.own.get(c, c) for c in fitted.inputs]
        vectors = VectorAssembler(inputCols=inputs, outputCol="_all", handleInvalid="keep").transform(train)
        fitted.slots = _selector(vectors, target, fitted.names, spec.selection)
        if fitted.slots is not None:
            fitted.names = fitted.columns_of(fitted.slots)
    return fitted


def _derive_step(definition: dict, train: DataFrame) -> Step:
    """A step for one definition; aggregates come from train, as it is after the definitions before."""
    derived_spec([definition])
    d = definition["definition"]
    if definition["expression_type"] == "row_wise":
        return Step("row_feature", {"name": definition["name"], "definition": d})
    table, rest = prepare.fit_group_feature(train, d["group_by"], d["value_column"], d.get("agg", "mean"))
    return Step("group_feature", {"name": definition["name"], "keys": d["group_by"], "rest": rest}, fixed(table))
