"""Boosting of several classes against plain loops over rows."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors

from tabloom.operators import boost, model


def plain(x, y, classes, rounds, depth, rate, least):
    """Scores of each row after the rounds, by trying every split of the bins."""
    bins = np.array([[math.nan] * x.shape[1]] * len(x))
    for f in range(x.shape[1]):
        known = x[~np.isnan(x[:, f]), f]
        cuts = sorted({float(np.quantile(known, k / boost.BINS)) for k in range(1, boost.BINS)})
        bins[:, f] = [math.nan if math.isnan(v) else sum(c < v for c in cuts) for v in x[:, f]]
    raw = np.tile(np.log([max((y == k).sum(), 1e-9) / len(y) for k in range(classes)]), (len(y), 1))
    for _ in range(rounds):
        p = np.exp(raw) / np.exp(raw).sum(1, keepdims=True)
        step = np.zeros_like(raw)
        for k in range(classes):
            g, h = p[:, k] - (y == k), p[:, k] * (1 - p[:, k])

            def grow(rows, left, g=g, h=h, k=k):
                step[rows, k] = -rate * g[rows].sum() / h[rows].sum()
                if not left:
                    return
                best = (1e-12, None)
                for f in range(x.shape[1]):
                    for missing_left in (True, False):
                        for c in range(boost.BINS):
                            b = bins[rows, f]
                            side = np.where(np.isnan(b), missing_left, b <= c)
                            one, two = rows[side], rows[~side]
                            if min(len(one), len(two)) < least:
                                continue
                            gain = g[one].sum() ** 2 / h[one].sum() + g[two].sum() ** 2 / h[two].sum() - g[rows].sum() ** 2 / h[rows].sum()
                            if gain > best[0] + 1e-9:
                                best = (gain, (one, two))
                if best[1]:
                    for part in best[1]:
                        grow(part, left - 1)

            grow(np.arange(len(y)), depth)
        raw += step
    return raw


def data(n, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        a, b = rng.random(), rng.gauss(0, 1)
        y = 0 if a < 0.4 else 1 if b > 0 else 2
        rows.append((k, [a if rng.random() > 0.1 else math.nan, b, float(rng.randint(0, 3))], y if rng.random() > 0.05 else rng.randint(0, 2)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(k, Vectors.dense(v), float(y)) for k, v, y in rows], ["id", "features", "label"])


@pytest.mark.parametrize("parts", [1, 5])
def test_scores_by_plain_loops(spark, monkeypatch, parts):
    monkeypatch.setattr(boost, "KEEP", 2)
    rows = data(200, 1)
    x, y = np.array([v for _, v, _ in rows]), np.array([c for *_, c in rows])
    df = frame(spark, rows).repartition(parts)
    fitted = boost.SoftmaxBoost(rounds=3, depth=2, rate=0.3, leastRows=10).fit(df)
    got = np.array([r.r for r in fitted.transform(df).orderBy("id").select(vector_to_array("rawPrediction").alias("r")).collect()])
    assert got == pytest.approx(plain(x, y, 3, 3, 2, 0.3, 10), abs=1e-9)


def test_learns_and_is_saved(spark, tmp_path):
    train, test = frame(spark, data(900, 2)), frame(spark, data(500, 3))
    estimator = model.get_model("tree_ensemble", "classification", n_classes=3, rounds=6)
    assert isinstance(estimator, boost.SoftmaxBoost) and estimator.getOrDefault("rounds") == 6
    fitted = estimator.fit(train)
    out = fitted.transform(test)
    assert out.where("prediction = label").count() / 500 > 0.88
    fitted.write().save(str(tmp_path / "m"))
    again = boost.SoftmaxBoostModel.load(str(tmp_path / "m"))
    assert again.transform(test).select("id", "probability").collect() == out.select("id", "probability").collect()
    assert again.numClasses == 3


def test_constant_features_and_absent_classes(spark):
    df = spark.createDataFrame([(Vectors.dense([1.0, math.nan]), 3.0 * (k % 2)) for k in range(60)], ["features", "label"])
    got = boost.SoftmaxBoost(rounds=1, depth=3).fit(df).transform(df).select(vector_to_array("probability").alias("p")).first().p
    assert len(got) == 4 and got[0] == pytest.approx(0.5, abs=1e-6) and got[1] < 1e-6
