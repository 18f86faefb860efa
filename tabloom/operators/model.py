"""Models, cross-validation, final fit and one-shot test on pyspark.ml pipelines."""

from __future__ import annotations

import json
import math
import time
from multiprocessing.pool import ThreadPool

from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.pipeline import Pipeline
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.util import inheritable_thread_target

from tabloom.functions.columns import corr
from tabloom.operators import metrics
from tabloom.operators.boost import SoftmaxBoost
from tabloom.operators.diagnose import numeric
from tabloom.operators.pipeline import FEATURES, Fitted, Spec, fit_spec, kept_number
from tabloom.operators.smote import smote
from tabloom.operators.split import position, time_position
from tabloom.sources.tables import handle, store_dir

#: Folds that are fitted at a time.
FOLDS_AT_ONCE = 4
#: Merged rows of a part, about, that boosted trees go over in each round.
ROUND_ROWS = 20_000


def get_model(family: str, task: str, n_classes: int = 2, n: int = 1, spread: float = 1.0, **params: object) -> Estimator:
    """linear or tree_ensemble for classification or regression; parameters the model doesn't have are left out. Linear
    models have the penalty of ridge regression with alpha 1, or of C = 1, on sums over n rows: Spark takes means, and a
    regression's target in units of its deviation `spread`. alpha and C may be given."""
    ridge = float(params.pop("alpha", 1.0)) * spread / max(1, n)
    inverse = 1.0 / (float(params.pop("C", 1.0)) * max(1, n))
    table = {
        ("linear", "regression"): lambda: LinearRegression(regParam=ridge, elasticNetParam=0.0, standardization=False, solver="normal"),
        ("linear", "classification"): lambda: LogisticRegression(regParam=inverse, elasticNetParam=0.0, standardization=False, maxIter=1000),
        ("tree_ensemble", "regression"): lambda: GBTRegressor(maxIter=200, stepSize=0.1, seed=42),
        ("tree_ensemble", "classification"): lambda: GBTClassifier(maxIter=200, stepSize=0.1, seed=42) if n_classes <= 2 else SoftmaxBoost(rounds=200, rate=0.1),
    }
    if (family, task) not in table:
        raise ValueError(f"no model {family} for {task}")
    model = table[family, task]()
    return model._set(**{k: v for k, v in params.items() if model.hasParam(k)})


class Pipe:
    """Preparation and a model, fitted on the same rows."""

    def __init__(self, prepared: Fitted, model: Model, target: str):
        self.prepared, self.model, self.target = prepared, model, target

    def transform(self, rows: DataFrame) -> DataFrame:
        return self.model.transform(self.prepared.transform(rows))


def fit_pipe(train: DataFrame, features: list[str] | Spec, target: str, family: str, task: str, **params: object) -> Pipe:
    """The features named, as they are, or what a Spec makes of the columns, and the model on them, both fitted on train."""
    rows = train.where(F.col(f"`{target}`").isNotNull())
    spec = features if isinstance(features, Spec) else Spec()
    prepared = fit_spec(spec, rows if isinstance(features, Spec) else rows.select(*(F.col(f"`{c}`").cast("double").alias(c) for c in features), F.col(f"`{target}`")), target)
    y = F.col(f"`{target}`")
    regression = task == "regression"
    facts = rows.agg(F.count(y).alias("n"), F.stddev_pop(y).alias("s") if regression else F.lit(1.0).alias("s"), F.lit(0).alias("k") if regression else F.count_distinct(y).alias("k")).first()
    model = get_model(family, task, facts.k, facts.n, facts.s or 1.0, **params)._set(labelCol=target, featuresCol=FEATURES)
    return Pipe(prepared, fit_merged(model, prepared.transform(rows, training=True)), target)


def fit_merged(model: Estimator, rows: DataFrame) -> Model:
    """The model fitted on rows. Boosted trees of squared errors go over their rows a thousand times, and see of rows with the
    same features their mean and number only; so these are made one, weighed by their number: the same trees."""
    same = isinstance(model, GBTRegressor) and model.getLossType() == "squared" and model.getSubsamplingRate() == 1 and model.getMinInstancesPerNode() == 1
    if not same or model.isSet("weightCol") or model.isSet("validationIndicatorCol"):
        return model.fit(rows)
    x, y = F.col(f"`{model.getFeaturesCol()}`"), F.col(f"`{model.getLabelCol()}`")
    merged = rows.groupBy(vector_to_array(x).alias("_x")).agg(F.avg(y.cast("double")).alias("_y"), F.count("*").cast("double").alias("_weight"))
    kept = merged.select(array_to_vector("_x").alias(model.getFeaturesCol()), F.col("_y").alias(model.getLabelCol()), "_weight").persist()
    # Each round is several short jobs over all parts of the rows.
    parts = math.ceil(max(1, kept.count()) / ROUND_ROWS)
    fitted = model.copy({model.weightCol: "_weight"}).fit(kept.coalesce(parts))
    kept.unpersist()
    return fitted


def score(predicted: DataFrame, target: str, task: str) -> dict[str, float]:
    if task == "regression":
        return metrics.regression(predicted, target, "prediction").first().asDict()
    out = metrics.classification(predicted.withColumn("prediction", F.col("prediction").cast("int")), target, "prediction").first().asDict()
    auc = _auc(predicted.withColumn("_p", vector_to_array("probability")), target)
    return out | ({"roc_auc": auc} if auc is not None else {})


def _auc(predicted: DataFrame, target: str) -> float | None:
    """Of two classes that of class 1; of more the mean over classes, each against the rest. None if a class is absent."""
    each = {r["class"]: r.auc for r in metrics.roc_auc_classes(predicted, target, "_p").collect()}
    if len(each) <= 2:
        return each.get(1)
    return None if None in each.values() else sum(each.values()) / len(each)


def balanced(train: DataFrame, target: str, imbalance: str | None, key: str | None, features: list[str] | None = None) -> DataFrame:
    """Training rows after the strategy: oversample_random and undersample_random deal in rows, oversample_smote makes rows
    between neighbours by the features (all columns but target and key, unless given), where these are known numbers;
    class_weight and none leave rows as they are, as does a class of a single row."""
    if imbalance in (None, "none", "class_weight"):
        return train
    if imbalance not in ("oversample_smote", "oversample_random", "undersample_random"):
        raise ValueError(f"unknown strategy: {imbalance}")
    if train.groupBy(target).count().agg(F.min("count")).first()[0] <= 1:
        return train
    if key is None:
        raise ValueError("resampling needs a key column")
    if imbalance == "oversample_smote":
        return smote(train, target, key, features or [c for c in train.columns if c not in (target, key)]).drop("_made")
    return resample(train, target, key, "under" if imbalance == "undersample_random" else "over").drop("copy")


def cross_validate(df: DataFrame, features: list[str] | Spec, target: str, family: str, task: str, fold: str = "fold", with_train: bool = False, ordered: bool = False, imbalance: str | None = None, key: str | None = None, parallelism: int = FOLDS_AT_ONCE, **params: object) -> DataFrame:
    """(fold, part, metric, value): preparation and model fitted on the other folds, scored on each. With ordered the
    folds are blocks of time, and each after the first is scored by what the blocks before it teach. Resampling by
    `imbalance` touches training rows only. One fit a fold; folds are few, and `parallelism` of them are fitted at a time,
    for a fit is a chain of many short jobs. Their training rows are kept meanwhile."""
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())

    def one(k: object) -> list[tuple]:
        train, held = df.where(F.col(fold) < k if ordered else F.col(fold) != k).drop(fold), df.where(F.col(fold) == k).drop(fold)
        train = balanced(train, target, imbalance, key, None if isinstance(features, Spec) else features).persist()
        without = lambda d: d.drop(key) if key and isinstance(features, Spec) else d
        fitted = fit_pipe(without(train), features, target, family, task, **params)
        parts = (("validation", held), ("train", train))[: 1 + with_train]
        found = [(k, part, m, v) for part, data in parts for m, v in score(fitted.transform(without(data)), target, task).items()]
        train.unpersist()
        fitted.prepared.release()
        return found

    asked = folds[1:] if ordered else folds
    with ThreadPool(max(1, min(parallelism, len(asked)))) as pool:
        rows = [r for found in pool.map(inheritable_thread_target(df.sparkSession)(one), asked, chunksize=1) for r in found]
    return df.sparkSession.createDataFrame(rows, "fold int, part string, metric string, value double")


def diagnose(scores: DataFrame, task: str) -> dict:
    """The gap between training and validation over folds; accuracy, or r2 for regression."""
    metric = "r2" if task == "regression" else "accuracy"
    wide = scores.where(F.col("metric") == metric).groupBy("fold").pivot("part", ["train", "validation"]).agg(F.first("value"))
    row = wide.agg(F.avg(F.col("train") - F.col("validation")).alias("gap"), F.stddev_pop(F.col("train") - F.col("validation")).alias("std")).first()
    return {"gap": row.gap, "std": row.std, "verdict": metrics.verdict(row.gap, row.std)}


def sweep(df: DataFrame, features: list[str] | Spec, target: str, task: str, alphas: list[float] | None = None) -> DataFrame:
    """(alpha, score, best): accuracy or r2 of linear models over 20 penalties from 1e-3 to 1e2 (of classification, C is
    1 / alpha); larger is better. The rows are read once and kept for all fits."""
    alphas = alphas if alphas is not None else [10 ** (-3 + 5 * i / 19) for i in range(20)]
    metric = "r2" if task == "regression" else "accuracy"
    kept = df.persist()
    rows = [(a, cross_validate(kept, features, target, "linear", task, alpha=a, C=1 / max(a, 1e-8)).where(F.col("metric") == metric).agg(F.avg("value")).first()[0]) for a in alphas]
    kept.unpersist()
    top = max(rows, key=lambda r: (r[1], -r[0]))[0]
    return df.sparkSession.createDataFrame([(a, s, a == top) for a, s in rows], "alpha double, score double, best boolean")


def finalize(train: DataFrame, features: list[str] | Spec, target: str, family: str, task: str, **params: object) -> str:
    """The id of a model fitted on all of train and saved; the same request is fitted once. With a Spec its preparation is the
    model's first stage, saved with it, so loading reads no training rows."""
    spark = train.sparkSession
    made = features.name if isinstance(features, Spec) else sorted(features)
    name = handle(made, target, family, task, params, train.schema.json(), train.agg(F.count("*"), F.sum(F.xxhash64(*train.columns).cast("decimal(38,0)"))).first())
    path = f"{store_dir(spark)}/models/{name}"
    if not _there(spark, path):
        if isinstance(features, Spec):
            pipe = fit_pipe(train, features, target, family, task, **params)
            PipelineModel([pipe.prepared, pipe.model]).write().save(path)
            pipe.prepared.release()
        else:
            facts = train.agg(F.count(target).alias("n"), F.stddev_pop(F.col(target)).alias("s") if task == "regression" else F.lit(1.0).alias("s"), F.count_distinct(target).alias("k")).first()
            model = get_model(family, task, facts.k, facts.n, facts.s or 1.0, **params)._set(labelCol=target, featuresCol=FEATURES)
            Pipeline(stages=[VectorAssembler(inputCols=features, outputCol=FEATURES, handleInvalid="keep"), model]).fit(train).write().save(path)
    return name


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def load_model(spark: SparkSession, name: str) -> PipelineModel:
    """A saved model; with a Spec its first stage is the fitted preparation."""
    return PipelineModel.load(f"{store_dir(spark)}/models/{name}")


def _claim(spark: SparkSession, path: str, holder: str) -> str:
    """Who holds the file: `holder`, if nobody made it before. Making a file that must not exist is one step of the file system, so of
    any number of callers one wins; the others wait until its name is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    at = fs.makeQualified(at)
    fs.mkdirs(at.getParent())
    if at.toUri().getScheme() == "file":
        # The local file system looks and makes in two steps through the first interface.
        won = spark._jvm.java.io.File(at.toUri().getPath()).createNewFile()
        stream = fs.create(at, True) if won else None
    else:
        try:
            stream = fs.create(at, False)
        except Exception as e:
            if not fs.exists(at):
                raise e
            stream = None
    if stream is not None:
        stream.write(bytearray(holder.encode()))
        stream.close()
        return holder
    for _ in range(100):
        if size := fs.getFileStatus(at).getLen():
            source = fs.open(at)
            try:
                return bytes(source.readNBytes(size)).decode()
            finally:
                source.close()
        time.sleep(0.1)
    return "a caller that did not leave its name"


def final_test(spark: SparkSession, split: str, model: str, test: DataFrame, target: str, task: str) -> dict[str, float]:
    """Scores on the test part. The first model to be tested on a split is the only one that ever may be: it is marked before the
    test part is looked at, so of models that are tested at the same time only one is."""
    used = _claim(spark, f"{store_dir(spark)}/tested/{split}.holder", model)
    if used != model:
        raise RuntimeError(f"split {split} was tested with {used}: another model violates the one-shot test rule")
    out = score(load_model(spark, model).transform(test), target, task)
    _claim(spark, f"{store_dir(spark)}/tested/{split}.scores", json.dumps(out))
    return out


def calibrate(predicted: DataFrame, target: str, method: str = "platt"):
    """A fitted map from the column `score` to a probability, on rows held out by the caller. isotonic: equal scores are one
    weighted row with their mean label first, so what is pooled grows with distinct scores; rows without score or label don't count."""
    if method not in ("platt", "isotonic"):
        raise ValueError(f"unknown method: {method}")
    known = predicted.where(F.col("score").isNotNull() & F.col(f"`{target}`").isNotNull())
    if method == "isotonic":
        counts = known.groupBy(F.col("score").cast("double").alias("score")).agg(F.avg(F.col(f"`{target}`").cast("double")).alias("_y"), F.count("*").cast("double").alias("_w"))
        return IsotonicRegression(labelCol="_y", featuresCol="score", weightCol="_w", predictionCol="calibrated").fit(counts)
    data = VectorAssembler(inputCols=["score"], outputCol="_score")
    return Pipeline(stages=[data, LogisticRegression(labelCol=target, featuresCol="_score", predictionCol="_label", rawPredictionCol="_raw", probabilityCol="calibrated")]).fit(known)


def permute(df: DataFrame, column: str, key: str, seed: int) -> DataFrame:
    """df with the values of a column moved to other rows: joined by two shuffled orders of the keys."""
    where, what = position(df, key, seed=seed), position(df.select(key, column), key, seed=seed + 1)
    return where.drop(column, "n").join(what.select("pos", column), "pos").drop("pos")


def permutation_importance(fitted: PipelineModel, df: DataFrame, features: list[str], target: str, task: str, key: str, repeats: int = 10) -> DataFrame:
    """(feature, importance, std): what accuracy or r2 loses when a feature is shuffled."""
    metric = "r2" if task == "regression" else "accuracy"
    base = score(fitted.transform(df), target, task)[metric]
    rows = [(f, r, base - score(fitted.transform(permute(df, f, key, 42 + 2 * r)), target, task)[metric]) for f in features for r in range(repeats)]
    spark = df.sparkSession
    return spark.createDataFrame(rows, "feature string, r int, loss double").groupBy("feature").agg(F.avg("loss").alias("importance"), F.stddev_pop("loss").alias("std")).orderBy(F.desc("importance"), "feature")


def coefficients(fitted: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    return sorted(zip(features, map(float, fitted.stages[-1].coefficients), strict=True), key=lambda x: -abs(x[1]))


def select_features(df: DataFrame, features: list[str], target: str, task: str, method: str = "auto", share: float | int = 0.8) -> list[str]:
    """filter (univariate F), embedded (importances of a forest of 200 trees, the median or more) or wrapper (forests of 100
    trees, one feature dropped a round); all are kept where there is one at most."""
    from tabloom.operators.associate import anova, f_scores

    if len(features) <= 1:
        return features
    method = ("embedded" if len(features) > 50 else "filter") if method == "auto" else method
    keep = kept_number(share, len(features))
    forest = lambda names, trees: dict(zip(names, Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="_f", handleInvalid="keep"), (RandomForestRegressor if task == "regression" else RandomForestClassifier)(labelCol=target, featuresCol="_f", numTrees=trees, seed=42)]).fit(df).stages[-1].featureImportances.toArray(), strict=True))
    if method == "filter":
        found = {r.column: r.f for r in f_scores(df, features, target).collect()} if task == "regression" else {c: anova(df, target, c).first().f for c in features}
    elif method == "embedded":
        found = forest(features, 200)
        ordered = sorted(found.values())
        middle = (ordered[(len(ordered) - 1) // 2] + ordered[len(ordered) // 2]) / 2
        found = {c: w if w >= middle else -1.0 for c, w in found.items()}
        keep = min(keep, sum(w >= 0 for w in found.values()))
    elif method == "wrapper":
        left = list(features)
        while len(left) > keep:
            weights = forest(left, 100)
            left.remove(min(left, key=lambda c: weights[c]))
        return left
    else:
        raise ValueError(f"unknown method: {method}")
    chosen = set(sorted(features, key=lambda c: -(found[c] or 0.0))[:keep])
    return [c for c in features if c in chosen] or features


def resample(df: DataFrame, y: str, key: str, how: str = "over") -> DataFrame:
    """Classes at the size of the largest (over: whole copies, then rows in shuffled order) or the smallest (under)."""
    sizes = df.groupBy(y).agg(F.count("*").alias("_n"))
    most = F.broadcast(sizes.agg(F.max("_n").alias("_max"), F.min("_n").alias("_min")))  # one row
    rows = position(df, key, [y]).join(most)
    if how == "under":
        return rows.where("pos <= _min").select(df.columns)
    copies = F.floor(F.col("_max") / F.col("n")) + (F.col("pos") <= F.col("_max") % F.col("n")).cast("int")
    return rows.select(*df.columns, F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias("copy"))


def calibration_rows(train: DataFrame, key: str, share: float = 0.2) -> DataFrame:
    """The last rows of train in the order of key, which calibrate() is fitted on."""
    placed = time_position(train.withColumn("_no_time", F.lit(None).cast("timestamp")), "_no_time", key)
    return placed.where(F.col("pos") > F.floor((1 - share) * F.col("n"))).select(train.columns)


def explain(fitted: PipelineModel, rows: DataFrame, features: list[str], target: str, task: str, key: str, top: int = 5, most: int = 20, repeats: int = 10) -> dict:
    """method, the `most` largest importances, and (inputs, actual, predicted) of the first `top` rows by key. Linear models
    have coefficients, the mean of those of all classes if these are several; others permutation importances."""
    last = fitted.stages[-1]
    if hasattr(last, "coefficientMatrix") and last.numClasses > 2:
        weights = last.coefficientMatrix.toArray().mean(axis=0)
        found, method = sorted(zip(features, map(float, weights), strict=True), key=lambda x: -abs(x[1])), "coefficients"
    elif hasattr(last, "coefficients"):
        found, method = coefficients(fitted, features), "coefficients"
    else:
        found = [(r.feature, r.importance) for r in permutation_importance(fitted, rows, features, target, task, key, repeats).collect()]
        method = "permutation_importance"
    first = fitted.transform(rows.orderBy(key).limit(top)).orderBy(key).select(*features, target, "prediction").collect()
    examples = [{"inputs": {c: r[c] for c in features}, "actual": r[target], "predicted": r["prediction"]} for r in first]
    return {"method": method, "importances": dict(found[:most]), "examples": examples}


def segment_columns(rows: DataFrame, error: str, columns: list[str], most: int = 5) -> DataFrame:
    """(column, strength), strongest first: |r| of a number with the error, and of strings the largest |r| of one
    category's indicator (all but the first category), in closed form from the counts of each category."""
    numbers = [c for c in columns if c in numeric(rows)]
    texts = [c for c in columns if c not in numbers]
    e = F.col(f"`{error}`").cast("double")
    out = rows.sparkSession.createDataFrame([], "column string, strength double")
    if numbers:
        parts = [F.struct(F.lit(c).alias("column"), F.abs(corr(F.col(f"`{c}`"), e)).alias("strength")) for c in numbers]
        out = out.union(rows.agg(F.array(*parts).alias("all")).select(F.inline("all")))
    if texts:
        pairs = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in texts]
        cells = rows.select(F.inline(F.array(*pairs)), e.alias("e")).groupBy("column", "value").agg(F.count("*").alias("n"), F.sum("e").alias("wrong"))
        all_ = F.broadcast(rows.agg(F.count("*").alias("total"), F.sum(e).alias("sum"), F.sum(e * e).alias("squares")))  # one row
        first = F.broadcast(cells.groupBy("column").agg(F.min("value").alias("first")))
        n, total = F.col("n").cast("double"), F.col("total").cast("double")
        r = F.try_divide(F.col("wrong") - n * F.col("sum") / total, F.sqrt((n - n * n / total) * (F.col("squares") - F.col("sum") * F.col("sum") / total)))
        found = cells.join(all_).join(first, "column").where("value is not null and value <> first").groupBy("column").agg(F.max(F.abs(r)).alias("strength"))
        out = out.union(found)
    return out.where("strength is not null").orderBy(F.desc("strength"), "column").limit(most)


def analyse_errors(predicted: DataFrame, target: str, segments: list[str] | None = None, prediction: str = "prediction", leave: tuple[str, ...] = ()) -> DataFrame:
    """(column, segment, n, error_rate), worst first: numbers by quartile, strings by value, nulls as nan. Without segments,
    the five columns that go with the error most; the first row, without a column, is of all rows."""
    y, p = F.col(f"`{target}`"), F.col(f"`{prediction}`")
    rows = predicted.withColumn("_wrong", (~y.eqNullSafe(p)).cast("double"))
    fine = [f.name for f in rows.schema if isinstance(f.dataType, (T.NumericType, T.StringType))]
    segments = segments or [r.column for r in segment_columns(rows, "_wrong", [c for c in fine if c not in (target, prediction, "_wrong", *leave)]).collect()]
    out = rows.agg(F.lit(None).cast("string").alias("column"), F.lit("all").alias("segment"), F.count("*").alias("n"), F.avg("_wrong").alias("error_rate"))
    for c in segments:
        part = metrics.quartile(rows, c).withColumn("_segment", F.col("quartile")) if c in numeric(rows) else rows.withColumn("_segment", F.col(f"`{c}`"))
        out = out.union(metrics.segment_errors(part, "_segment", target, prediction).select(F.lit(c).alias("column"), "segment", "n", "error_rate"))
    return out.orderBy(F.col("column").isNotNull(), F.desc("error_rate"), "column", "segment")
