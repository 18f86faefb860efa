"""Preparation is learnt from training rows only, and its parts choose as documented."""

import random
import shutil
import statistics
from pathlib import Path

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tabloom.operators import associate, diagnose, metrics, model, pipeline, prepare, ranges
from tabloom.sources import tables
from tabloom.sources.tables import store_dir

SCHEMA = "id long, x double, z double, c string, wide string, flag boolean, y double"


@pytest.fixture(scope="module")
def rows(spark):
    made = [(i, None if i % 7 == 0 else float(i % 13), float(i * i % 31), None if i % 11 == 0 else "abc"[i % 3], f"w{i % 20}", i % 2 == 0, float(i % 13 * 2 + i % 3)) for i in range(300)]
    return spark.createDataFrame(made, SCHEMA).repartition(3).persist()


def vectors(df):
    return {r.id: r.v for r in df.select("id", vector_to_array(pipeline.FEATURES).alias("v")).collect()}


def test_specs_by_role(rows):
    train = rows.drop("id")
    roles = pipeline.train_roles(train, "y")
    assert roles == {"x": "numeric_discrete", "z": "numeric_continuous", "c": "categorical_nominal", "wide": "categorical_nominal", "flag": "numeric_discrete"} or roles["c"] == "categorical_nominal"
    assert pipeline.imputer_spec(train, "y")["x"] == "median" and pipeline.imputer_spec(train, "y")["c"] == "constant"
    assert pipeline.imputer_spec(train, "y", {"categorical_nominal": "mode"})["c"] == "mode"
    assert pipeline.imputer_spec(train, "y", {"x": "mean"}) == {"x": "mean"}
    assert pipeline.encoder_spec(train, "y") == {"c": "one_hot", "wide": "target_encoding"}
    assert pipeline.encoder_spec(train, "y", {"wide": "label"}) == {"c": "one_hot", "wide": "label"}
    assert pipeline.outlier_spec(train, "y") == ("cap", ["x", "z"])
    assert prepare.scaler_method("auto", "tree_ensemble") == "none" and prepare.scaler_method() == "standard"
    with pytest.raises(ValueError):
        pipeline.imputer_spec(train, "y", "all")
    with pytest.raises(ValueError):
        pipeline.derived_spec([{"expression_type": "other"}])


def test_held_out_rows_teach_nothing(rows):
    """However the rows outside the training part change, training features stay, and theirs follow from training facts."""
    spec = pipeline.Spec(imputers={"x": "mean", "z": "median", "c": "mode"}, encoders={"c": "one_hot", "wide": "target_encoding"}, scaler="standard", outliers=("cap", ["z"]))
    train = rows.where("id % 3 <> 0")
    fitted = pipeline.fit_spec(spec, train, "y")
    wild = rows.withColumns({"z": F.when(F.col("id") % 3 == 0, F.lit(1e9)).otherwise(F.col("z")), "y": F.when(F.col("id") % 3 == 0, F.lit(-1e9)).otherwise(F.col("y")), "wide": F.when(F.col("id") % 3 == 0, F.lit("new")).otherwise(F.col("wide"))})
    again = pipeline.fit_spec(spec, wild.where("id % 3 <> 0"), "y")
    a, b = vectors(fitted.transform(train)), vectors(again.transform(wild))
    assert all(b[i] == pytest.approx(v) for i, v in a.items())
    mean = train.agg(F.avg("y")).first()[0]
    assert b[3][-1] == pytest.approx(mean)  # an unknown category
    assert max(v[1] for v in b.values()) < 5  # capped by the fences of training rows
    assert len(fitted.names) == len(a[1]) == 2 + 2 + 1 and fitted.names[2:4] == ["c_b", "c_c"]  # training rows have no a


def test_target_encoding_leaves_out_own_fold(rows, spark):
    spec = pipeline.Spec(encoders={"c": "target_encoding"}, smoothing=0.0)
    lone = spark.createDataFrame([(i, 1.0, 1.0, f"only{i}", "w", True, float(i)) for i in range(20)], SCHEMA)
    fitted = pipeline.fit_spec(spec, lone, "y")
    inside, outside = vectors(fitted.transform(lone, training=True)), vectors(fitted.transform(lone))
    assert all(v == [pytest.approx(9.5)] for v in inside.values())  # a category of one row says nothing of that row
    assert all(outside[i] == [float(i)] for i in range(20))


def test_selection_and_removal(rows):
    spec = pipeline.Spec(selection=("filter", 2, "regression"))
    fitted = pipeline.fit_spec(spec, rows.drop("id").where("x is not null").withColumn("same", F.col("y") * 2), "y")
    assert len(fitted.names) == 2 and "same" in fitted.names
    removing = pipeline.fit_spec(pipeline.Spec(imputers={"z": "mean"}, outliers=("remove", ["z"])), rows.withColumn("z", F.when(F.col("id") == 5, F.lit(1e6)).otherwise(F.col("z"))), "y")
    wild = rows.withColumn("z", F.when(F.col("id") == 5, F.lit(1e6)).otherwise(F.col("z")))
    assert removing.transform(wild).count() == 300 and removing.transform(wild, training=True).count() == 299


def test_cross_validation_with_spec_resampling_and_saved_pipe(rows, spark):
    spec = pipeline.Spec(imputers={"x": "median", "z": "mean"}, encoders={"c": "one_hot"}, scaler="standard")
    data = rows.withColumns({"y": (F.col("id") % 5 == 0).cast("int"), "fold": (F.col("id") % 3).cast("int")})
    scores = model.cross_validate(data, spec, "y", "linear", "classification", imbalance="oversample_random", key="id")
    assert {r.metric for r in scores.collect()} == {"accuracy", "f1_macro", "roc_auc"} and scores.select("fold").distinct().count() == 3
    train = data.drop("fold", "id")
    name = model.finalize(train, spec, "y", "linear", "classification")
    assert name == model.finalize(train, spec, "y", "linear", "classification")
    out = model.load_model(spark, name).transform(data)
    assert out.count() == 300 and "prediction" in out.columns
    errors = model.analyse_errors(out.drop("_features", "rawPrediction", "probability", "fold"), "y", leave=("id",)).collect()
    assert errors[0].segment == "all" and errors[0].n == 300 and {r.column for r in errors[1:]} <= {"x", "z", "c", "wide"}


def test_ridge_as_on_sums(rows):
    """The penalty is alpha on sums: w = sum(z y) / (sum(z z) + alpha) for centred z and y."""
    data = rows.where("x is not null").select("x", "y")
    fitted = model.fit_pipe(data, ["x"], "y", "linear", "regression", alpha=50.0)
    r = data.agg(F.covar_pop("x", "y").alias("c"), F.var_pop("x").alias("v"), F.count("*").alias("n")).first()
    assert fitted.model.coefficients[0] == pytest.approx(r.c * r.n / (r.v * r.n + 50.0), rel=1e-6)


def test_split_quality(rows, spark):
    part = rows.withColumn("part", F.when(F.col("id") < 200, "train").otherwise("test")).withColumns({"late": F.col("id").cast("double"), "none": F.lit(None).cast("string")})
    found = {r.column: r for r in associate.validate_split(part.drop("id"), target="y").collect()}
    assert found["late"].flagged and found["late"].statistic == 1.0 and not found["wide"].flagged and found["c"].test == "chi_square"
    assert found["none"].test is None and not found["none"].flagged
    many = part.select("part", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("k"))
    assert associate.validate_split(many) is None and associate.validate_split(many, force=True).count() == 1


def test_profile_and_frequency(spark):
    days = spark.sql("SELECT timestamp'2024-01-01' + make_interval(0, id, 0, 0, 0, 0, 0) AS m, timestamp'2024-01-01' + make_interval(0, 0, 0, id, 0, 0, 0) AS d, id % 2 = 0 AS flag, string(id % 3) AS s, double(id) AS x FROM range(12)")
    assert diagnose.frequency(days, "m") == "MS" and diagnose.frequency(days, "d") == "D"
    found = {r.column: r for r in diagnose.profile_dataset(days).collect()}
    assert found["flag"].mean == 0.5 and found["flag"].cardinality == 2 and found["x"].is_normal is not None and found["d"].frequency == "D"
    assert found["s"].top_values[0].value == "0" and found["s"].top_values[0]["count"] == 4 and found["s"].mean is None
    quick = {r.column: r for r in diagnose.profile_dataset(days, "quick").collect()}
    assert quick["x"].kurtosis is None and quick["s"].top_values is None and quick["s"].cardinality == 3


def test_outlier_examples(spark):
    rows = spark.createDataFrame([(i, 1e6 if i in (7, 3) else float(i % 10)) for i in range(100)], "id long, x double")
    assert diagnose.outliers(rows, ["x"], key="id").first().examples == [3, 7]


def test_explanation_and_calibration_rows(rows, spark):
    data = rows.where("x is not null").select("id", "x", "z", "y")
    name = model.finalize(data.select("x", "z", "y"), ["x", "z"], "y", "linear", "regression")
    told = model.explain(model.load_model(spark, name), data, ["x", "z"], "y", "regression", "id", top=3)
    assert told["method"] == "coefficients" and next(iter(told["importances"])) == "x" and len(told["examples"]) == 3 and told["examples"][0]["inputs"]["x"] == 1.0
    tail = [r.id for r in model.calibration_rows(data, "id").orderBy("id").collect()]
    kept = [r.id for r in data.orderBy("id").collect()]
    assert tail == kept[int(0.8 * len(kept)) :]


def test_folds_and_splits_are_kept(rows, spark):
    tables.save_split(rows.withColumn("part", F.when(F.col("id") < 10, "test").otherwise("train")), "kept", target="y")
    assert tables.split_meta(spark, "kept") == {"n_train": 290, "n_test": 10, "target": "y"}
    tables.save_folds(rows.withColumn("fold", (F.col("id") % 4).cast("int")), "kept", "kept", "random")
    back, facts = tables.load_folds(spark, "kept")
    assert back.count() == 300 and facts["n_folds"] == 4


def test_one_hot_vector_and_auc_of_classes(rows, spark):
    out = prepare.encode_one_hot_vector(rows.where("c <> 'a'"), rows, "c", "v").select("c", vector_to_array("v").alias("v")).distinct().collect()
    assert {r.c: r.v for r in out} == {"a": [0.0, 0.0], "b": [1.0, 0.0], "c": [0.0, 1.0], None: [0.0, 0.0]}
    three = spark.createDataFrame([(0, [0.9, 0.1, 0.0]), (1, [0.1, 0.8, 0.1]), (2, [0.2, 0.9, 0.5])], "y int, p array<double>")
    assert {r["class"]: r.auc for r in metrics.roc_auc_classes(three, "y", "p").collect()} == {0: 1.0, 1: 0.5, 2: 1.0}


def test_saved_preparation_reads_no_training_rows(spark, tmp_path):
    rng = random.Random(8)
    rows = [(k, rng.choice([None, rng.gauss(3, 2)]), rng.choice("abcd"), rng.choice("uvw"), rng.choice(["p", None, "q"]), rng.random() < 0.5) for k in range(400)]
    data = spark.createDataFrame([(*r, 2.0 * (r[1] or 0) + (r[2] == "a") + rng.gauss(0, 0.1)) for r in rows], "id long, x double, c string, d string, e string, b boolean, y double")
    where = str(tmp_path / "train.parquet")
    data.write.parquet(where)
    spec = pipeline.Spec(
        imputers={"x": "median", "b": "most_frequent"}, encoders={"c": "target_encoding", "d": "one_hot", "e": "label"}, scaler="robust", outliers=("cap", ["x"]),
        derived=[{"name": "mx", "expression_type": "aggregation", "definition": {"group_by": ["c"], "value_column": "x", "agg": "median"}}, {"name": "x2", "expression_type": "row_wise", "definition": {"kind": "arithmetic", "expression": "x * x"}}],
        selection=("filter", 0.8, "regression"),
    )
    train = spark.read.parquet(where)
    fitted = model.fit_pipe(train, spec, "y", "linear", "regression")
    test = data.where("id % 3 = 0").withColumn("c", F.when(F.col("id") == 3, F.lit("never")).otherwise(F.col("c")))
    before = {r.id: r.prediction for r in fitted.transform(test).collect()}
    name = model.finalize(train, spec, "y", "linear", "regression")
    shutil.rmtree(where)
    loaded = model.load_model(spark, name)
    assert isinstance(loaded.stages[0], pipeline.Fitted) and loaded.stages[0].spec == spec
    assert loaded.stages[0].names == fitted.prepared.names
    out = loaded.transform(test)
    assert "train.parquet" not in "".join(out.inputFiles())
    assert {r.id: r.prediction for r in out.collect()} == pytest.approx(before, abs=1e-9)
    left = [p.name for p in Path(store_dir(spark).removeprefix("file:")).joinpath("models").iterdir() if p.name.startswith(name)]
    assert left == [name]


def test_preparation_as_a_stage(spark):
    data = spark.createDataFrame([(float(k), "ab"[k % 2], float(3 * k + k % 2)) for k in range(40)], "x double, c string, y double")
    stages = [pipeline.Preparation(pipeline.Spec(imputers={"x": "mean"}, encoders={"c": "label"}), "y"), LinearRegression(labelCol="y", featuresCol=pipeline.FEATURES)]
    got = Pipeline(stages=stages).fit(data).transform(data.drop("y")).orderBy("x").select("prediction").collect()
    assert [r.prediction for r in got] == pytest.approx([3.0 * k + k % 2 for k in range(40)], abs=1e-3)


@pytest.mark.parametrize("parts", [1, 6])
def test_median_by_group(spark, monkeypatch, parts):
    monkeypatch.setattr(ranges, "SAMPLE_ROWS", 100)
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, float(rng.randint(0, 40)), rng.random()])) for _ in range(900)] + [("lone", None), ("one", 7.0)]
    train = spark.createDataFrame(rows, "k string, v double").repartition(parts)
    got = {r.k: r.m for r in prepare.group_feature(train, train.select("k").distinct().union(spark.createDataFrame([("new",)], "k string")), "m", ["k"], "v", "median").collect()}
    whole = statistics.median(v for _, v in rows if v is not None)
    want = {k: statistics.median([v for g, v in rows if g == k and v is not None]) for k in ("a", "b", "one")}
    assert got == pytest.approx(want | {"lone": whole, "new": whole, None: whole})
