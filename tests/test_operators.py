import pytest
from pyspark.sql import functions as F

from tabloom.operators import associate, diagnose, metrics, model, prepare, split, tracking
from tabloom.sources.tables import handle, load_dataset, load_part, save_split
from tabloom.streaming.profile import windowed_profile


@pytest.fixture
def frame(spark):
    rows = [(i, float(i % 7) if i % 10 else None, "ab"[i % 2], i % 2, i % 5) for i in range(100)]
    return spark.createDataFrame(rows, "id long, x double, c string, y int, `group by` int")


def test_csv_types_and_handles(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("n,d,s,b,none\n1,1.5,x,true,NA\n2,NaN,,false,\n")
    name, df = load_dataset(spark, str(path))
    assert [t for _, t in df.dtypes] == ["bigint", "double", "string", "boolean", "string"]
    assert df.collect()[1].d is None and df.collect()[1].s is None
    assert name == load_dataset(spark, str(path))[0] != load_dataset(spark, str(path), ";")[0]
    path.write_text("n,d,s,b,none\n1,1.5,x,true,NA\n2,NaN,,false,\n3,1.0,y,true,\n")
    assert name != load_dataset(spark, str(path))[0]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        load_dataset(spark, str(tmp_path / "missing.csv"))


def test_diagnostics(frame):
    missing = {r.column: r.missing_pct for r in diagnose.missingness(frame).collect()}
    assert missing == {"x": pytest.approx(10.0)}
    roles = {r.column: r.role for r in diagnose.column_roles(frame).collect()}
    assert roles == {"id": "identifier", "x": "numeric_continuous", "c": "categorical_nominal", "y": "boolean", "group by": "numeric_discrete"}
    suspects = {r.column: r.suspects for r in diagnose.leakage(frame.withColumn("leak", F.col("y")), "y").collect()}
    assert "high_correlation" in suspects["leak"] and suspects["id"] == "identifier_like"
    assert diagnose.infer_target(["a", "price"], "find the Price") == "price" and diagnose.infer_target(["a", "b"], "?") == "b"
    with pytest.raises(ValueError):
        diagnose.outliers(frame, ["x"], "other")


def test_missing_by_category(spark):
    rows = [("xyz"[i % 3] if i % 11 else None, None if i % 3 == 2 else 1.0, i % 2 == 0, None if i % 2 else f"t{i % 50:03d}", "same", i) for i in range(330)]
    df = spark.createDataFrame(rows, "flag string, v double, b boolean, t string, same string, i int").repartition(3)
    frame = df.toPandas()
    code = lambda c: frame[c].map({v: k for k, v in enumerate(sorted(frame[c].dropna().unique()))}).fillna(-1).astype(float)
    got = {r.column: r for r in diagnose.missingness(df).collect()}
    assert set(got) == {"flag", "v", "t"}
    for c in got:
        mask = frame[c].isna().astype(float)
        others = [code(o) if o in ("flag", "b", "t") else frame[o] for o in ("flag", "b", "t", "v", "i") if o != c]
        assert got[c].max_abs_r == pytest.approx(max(abs(r) for r in map(mask.corr, others) if r == r))
    assert got["v"].likely_mar and got["t"].likely_mar and not got["flag"].likely_mar
    assert {r.column: r.max_abs_r for r in diagnose.missingness(df.select("v", "same")).collect()} == {"v": 0.0}


def test_leaking_date_as_text(spark):
    rows = [("2024-03-01", "2024-02-01", "word", f"2024-01-0{i}", i) for i in range(1, 10)]
    df = spark.createDataFrame(rows, "late string, early string, note string, outcome string, y int")
    for data in (df, df.withColumn("outcome", F.to_date("outcome"))):
        got = {r.column: (r.after_outcome, r.suspects) for r in diagnose.leakage(data.withColumn("early", F.lit("2023-01-01")), "y", "outcome").collect()}
        assert got == {"late": (1.0, "timestamped_after_outcome"), "early": (0.0, ""), "note": (0.0, "")}


def test_splits_are_stable_and_disjoint(spark, frame):
    for make in (lambda d: split.random_split(d, "id"), lambda d: split.stratified_split(d, "id", "c"), lambda d: split.group_split(d, "group by"), lambda d: split.split_dataset(d, "id", "c")):
        a = {r.id: r.part for r in make(frame).collect()}
        assert a == {r.id: r.part for r in make(frame.repartition(7)).collect()} and len(a) == 100
        assert sum(p == "test" for p in a.values()) == 20
    by_group = split.group_split(frame, "group by").groupBy("group by").agg(F.count_distinct("part").alias("n"))
    assert by_group.where("n > 1").isEmpty()
    folds = split.random_folds(frame, "id", 7).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in folds) == [14] * 5 + [15] * 2
    assert [split.fold_count(n) for n in (999, 1000, 50_000, 50_001)] == [10, 5, 5, 3]


def test_saved_parts(spark, frame):
    save_split(split.random_split(frame, "id"), "t1")
    assert (load_part(spark, "t1", "train").count(), load_part(spark, "t1", "test").count()) == (80, 20)


def test_features(frame):
    defs = [{"name": "r", "expression_type": "row_wise", "definition": {"kind": "arithmetic", "expression": "x * 2 + `group by`"}}, {"name": "m", "expression_type": "aggregation", "definition": {"group_by": ["c"], "value_column": "r", "agg": "max"}}]
    assert prepare.derive(frame, defs).where("m is null").isEmpty()
    for bad in ("__import__('os')", "nope + 1", "x; drop"):
        with pytest.raises(ValueError):
            prepare.arithmetic(bad, frame.columns)
    filled = prepare.impute(frame, frame, {"x": "median"})
    assert filled.where("x is null").isEmpty() and filled.count() == 100
    unseen = frame.withColumn("c", F.lit("new"))
    assert {r.v for r in prepare.encode_label(frame, unseen, "c", "v").collect()} == {-1}
    assert {r.v for r in prepare.encode_frequency(frame, unseen, "c", "v").collect()} == {0.0}
    assert {r.v for r in prepare.encode_target(frame, unseen, "c", "y", "v").collect()} == {0.5}
    assert [prepare.auto_impute(*a) for a in (("identifier", False, 1), ("boolean", False, 60), ("numeric_discrete", True, 5), ("boolean", True, 5))] == [None, "drop_rows", "model_based", "constant"]
    constant = frame.withColumn("k", F.lit(3.0))
    assert {r.k for r in prepare.scale(constant, constant, ["k"], "minmax").collect()} == {0.0}


def test_model_is_tested_once(spark, frame):
    train = frame.fillna(0.0).withColumn("y", (F.col("x") > 3).cast("int"))
    a = model.finalize(train, ["x"], "y", "linear", "classification")
    assert a == model.finalize(train, ["x"], "y", "linear", "classification")
    b = model.finalize(train, ["x", "group by"], "y", "linear", "classification")
    first = model.final_test(spark, "s1", a, train, "y", "classification")
    assert first["accuracy"] > 0.9 and first["roc_auc"] == pytest.approx(1.0)
    assert model.final_test(spark, "s1", a, train, "y", "classification") == first
    with pytest.raises(RuntimeError, match="violates the one-shot test rule"):
        model.final_test(spark, "s1", b, train, "y", "classification")
    loss = model.permutation_importance(model.load_model(spark, b), train, ["x", "group by"], "y", "classification", "id", repeats=2)
    assert loss.first().feature == "x"
    assert metrics.verdict(0.2, 0) == "overfitting" and metrics.verdict(-0.1, 0) == "underfitting" and metrics.verdict(0.12, 0.01) == "good_fit"
    with pytest.raises(ValueError):
        model.get_model("linear", "clustering")


def test_tracking(spark):
    e = tracking.create_experiment(spark, "x")
    run = tracking.start_run(spark, e)
    assert tracking.log_metrics(spark, e, run, {"f1": "0.5", "bad": "no", "none": None}) == ["f1"]
    tracking.log_parameters(spark, e, run, {"long": "p" * 600})
    tracking.end_run(spark, e, run)
    got = {r.key: (r.value, r.number) for r in tracking.get_run(spark, run).collect()}
    assert got["f1"][1] == 0.5 and len(got["long"][0]) == 500 and got["status"][0] == "FINISHED"


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events*.parquet")
    q = windowed_profile(stream, "ts", "value").writeStream.format("memory").queryName("p").outputMode("complete").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(str, spark.table("p").collect())) == sorted(map(str, windowed_profile(events, "ts", "value").collect()))


def test_tails_have_their_published_values():
    from tabloom.functions import tails

    for got, want in [
        (tails.chi_square_tail(3.841458820694124, 1), 0.05),
        (tails.chi_square_tail(18.307038053275146, 10), 0.05),
        (tails.chi_square_tail(2.0, 2), 0.36787944117144233),
        (tails.t_tail(2.2281388519649385, 10), 0.05),
        (tails.t_tail(-12.706204736432095, 1), 0.05),
        (tails.f_tail(4.964602743730711, 1, 10), 0.05),
        (tails.f_tail(1.0, 7, 7), 0.5),
    ]:
        assert got == pytest.approx(want, rel=1e-9)
    assert tails.chi_square_tail(0, 3) == tails.f_tail(0, 2, 9) == 1.0


def test_normality_of_few_equal_and_skewed_values(spark):
    from statistics import NormalDist

    bell = [NormalDist().inv_cdf((i + 0.5) / 500) for i in range(500)]
    rows = [(bell[i], bell[i] ** 2, 1.0, float(i) if i < 7 else None, float("nan")) for i in range(500)]
    got = {r.column: r for r in associate.normality(spark.createDataFrame(rows, "bell double, skewed double, same double, few double, none double"), ["bell", "skewed", "same", "few", "none"]).collect()}
    assert got["bell"].is_normal and not got["skewed"].is_normal and got["skewed"].p_value < 1e-9
    assert [(got[c].n, got[c].k2, got[c].is_normal) for c in ("same", "few", "none")] == [(500, None, False), (7, None, False), (0, None, False)]


def test_shift_and_p_values_of_associations(spark):
    rows = spark.range(2000).selectExpr("id % 2 = 0 AS first", "cast((id * 7919) % 1000 AS double) AS x", "cast((id * 7919) % 1000 + if(id % 2 = 0, 300, 0) AS double) AS y", "id % 3 AS g", "cast(id % 3 + (id * 31) % 7 AS double) AS z")
    assert not associate.shift(rows, "x", "first").first().shifted
    assert associate.shift(rows, "y", "first").first().shifted
    assert associate.associate(rows, "g", "z", False, True)["p_value"] < 1e-9
    assert associate.associate(rows, "x", "z", True, True)["p_value"] > 0.01
    assert associate.associate(rows, "x", "x", True, True)["p_value"] == 0.0
    assert associate.associate(rows, "g", "first", False, False)["p_value"] > 0.9


def test_rounds_and_trees_of_the_reference(spark, monkeypatch):
    assert model.get_model("tree_ensemble", "regression").getMaxIter() == 200
    assert model.get_model("tree_ensemble", "classification").getMaxIter() == 200
    assert model.get_model("tree_ensemble", "classification", n_classes=3).getNumTrees() == 200
    trees = []
    for kind in ("RandomForestRegressor", "RandomForestClassifier"):
        real = getattr(model, kind)
        monkeypatch.setattr(model, kind, lambda real=real, **p: (trees.append(p["numTrees"]), real(**p | {"numTrees": 2}))[1])
    rows = spark.createDataFrame([(float(i), float(i % 3), i % 2) for i in range(40)], "a double, b double, y int")
    for task in ("regression", "classification"):
        model.select_features(rows, ["a", "b"], "y", task, "embedded")
    assert trees == [200, 200]


def test_auc_of_three_classes(spark):
    from pyspark.ml.linalg import Vectors

    rows = [(i % 3, float(i % 2), Vectors.dense([(i * 7 % 10) / 20, (i * 3 % 11) / 30, 1 - (i * 7 % 10) / 20 - (i * 3 % 11) / 30])) for i in range(30)]
    df = spark.createDataFrame(rows, ["y", "prediction", "probability"])

    def auc(c):
        pairs = [(a[2][c], b[2][c]) for a in rows for b in rows if a[0] == c and b[0] != c]
        return sum(1.0 if p > q else 0.5 if p == q else 0.0 for p, q in pairs) / len(pairs)

    assert model.score(df, "y", "classification")["roc_auc"] == pytest.approx(sum(map(auc, range(3))) / 3)
    assert "roc_auc" not in model.score(df.where("y < 2"), "y", "classification")
