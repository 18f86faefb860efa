"""Boosted trees on rows of the same features made one."""

import random

import pytest
from pyspark.ml.feature import VectorAssembler

from tabloom.operators import model


def test_boosted_on_merged_rows_are_the_same_trees(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(float(a := rng.randrange(40)), float(b := rng.randrange(3)), 3.0 * a - 7.0 * b * b + rng.gauss(0, 5)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    seen = []
    fit = model.GBTRegressor.fit
    monkeypatch.setattr(model.GBTRegressor, "fit", lambda self, data, *p: (seen.append(data.count()), fit(self, data, *p))[1])
    pipe = model.fit_pipe(df, ["a", "b"], "y", "tree_ensemble", "regression", maxIter=8)
    assert seen == [len({r[:2] for r in rows})]
    vectors = VectorAssembler(inputCols=["a", "b"], outputCol="x").transform(df)
    plain = fit(model.GBTRegressor(maxIter=8, stepSize=0.1, seed=42, labelCol="y", featuresCol="x"), vectors).transform(vectors)
    want = {(r.a, r.b): r.prediction for r in plain.collect()}
    got = {(r.a, r.b): r.prediction for r in pipe.transform(df).collect()}
    assert got == pytest.approx(want, rel=1e-9)


def test_options_that_count_rows_leave_them_as_they_are(spark, monkeypatch):
    df = spark.createDataFrame([(float(i % 2), float(i)) for i in range(20)], "a double, y double")
    seen = []
    fit = model.GBTRegressor.fit
    monkeypatch.setattr(model.GBTRegressor, "fit", lambda self, data, *p: (seen.append(data.count()), fit(self, data, *p))[1])
    model.fit_pipe(df, ["a"], "y", "tree_ensemble", "regression", maxIter=1, minInstancesPerNode=5)
    assert seen == [20]
