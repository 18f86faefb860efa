"""Calibration, sweeps, verdicts, markers and the parts of tracking that no query runs."""

import math
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tabloom.operators import metrics, model, tracking
from tabloom.sources.tables import store_dir


def isotonic(rows):
    """(score, fitted) of (score, label), by pooling neighbours as long as they fall."""
    sums = {}
    for s, y in rows:
        a, n = sums.get(s, (0.0, 0))
        sums[s] = a + y, n + 1
    blocks = []
    for s in sorted(sums):
        blocks.append([[s], *sums[s]])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            scores, a, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + scores, blocks[-1][1] + a, blocks[-1][2] + n]
    return {s: a / n for scores, a, n in blocks for s in scores}


def test_isotonic_calibration_is_the_plain_loop(spark):
    rng = random.Random(5)
    rows = [(round(rng.random(), 3), None) for _ in range(10_000)]
    rows = [(s, float(rng.random() < s * s)) for s, _ in rows]
    df = spark.createDataFrame([*rows, (None, 1.0), (0.5, None)], "score double, y double").repartition(6)
    fitted = model.calibrate(df, "y", "isotonic")
    want = isotonic(rows)
    got = {r.score: r.calibrated for r in fitted.transform(spark.createDataFrame([(s,) for s in want], "score double")).collect()}
    assert got == pytest.approx(want, abs=1e-9)


def test_platt_calibration_and_its_rows(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([(k, x := rng.gauss(0, 1), float(rng.random() < 1 / (1 + math.exp(-2 * x - 1)))) for k in range(4_000)], "id long, score double, y double")
    fitted = model.calibrate(df, "y").stages[-1]
    assert fitted.coefficients[0] == pytest.approx(2, abs=0.25) and fitted.intercept == pytest.approx(1, abs=0.2)
    last = model.calibration_rows(df, "id")
    assert last.agg(F.min("id"), F.count("*")).first() == (3_200, 800)
    with pytest.raises(ValueError, match="unknown method"):
        model.calibrate(df, "y", "other")


def test_sweep_and_diagnose(spark):
    rng = random.Random(7)
    df = spark.createDataFrame([(x := rng.gauss(0, 1), 3 * x + rng.gauss(0, 0.3), k % 2) for k in range(120)], "x double, y double, fold int").coalesce(2)
    found = {r.alpha: (r.score, r.best) for r in model.sweep(df, ["x"], "y", "regression", [0.01, 10.0, 1_000.0]).collect()}
    for alpha, (score, _) in found.items():
        each = model.cross_validate(df, ["x"], "y", "linear", "regression", alpha=alpha).where("metric = 'r2'")
        assert each.agg(F.avg("value")).first()[0] == pytest.approx(score)
    assert [b for _, b in found.values()] == [s == max(v for v, _ in found.values()) for s, _ in found.values()]
    scores = spark.createDataFrame([(0, "train", "r2", 0.9), (0, "validation", "r2", 0.7), (1, "train", "r2", 0.8), (1, "validation", "r2", 0.5)], "fold int, part string, metric string, value double")
    told = model.diagnose(scores, "regression")
    assert told["gap"] == pytest.approx(0.25) and told["std"] == pytest.approx(0.05) and told["verdict"] == "overfitting"
    summary = {r.metric: (r["mean"], r["std"]) for r in metrics.fold_summary(scores.where("part = 'train'")).collect()}
    assert summary == {"r2": (pytest.approx(0.85), pytest.approx(0.05))}
    assert metrics.best_threshold(spark.createDataFrame([(0, 0.1), (1, 0.35), (0, 0.3), (1, 0.9)], "y int, s double"), "y", "s") == pytest.approx(0.31)


def test_one_of_two_models_is_tested(spark):
    train = spark.createDataFrame([(float(k), float(k % 5), float(k > 20)) for k in range(40)], "x double, z double, y double")
    names = [model.finalize(train, f, "y", "linear", "classification") for f in (["x"], ["x", "z"])]

    def one(name):
        try:
            return model.final_test(spark, "raced", name, train, "y", "classification")
        except RuntimeError as e:
            assert "violates the one-shot test rule" in str(e)
            return None

    with ThreadPoolExecutor(4) as pool:
        out = list(pool.map(one, names * 4))
    won = {k % 2 for k, o in enumerate(out) if o}
    assert len(won) == 1 and sum(o is not None for o in out) == 4
    assert one(names[won.pop()]) == next(o for o in out if o)


def test_claims(spark, tmp_path):
    path = f"{tmp_path}/deep/x.holder"
    with ThreadPoolExecutor(8) as pool:
        held = list(pool.map(lambda k: model._claim(spark, path, f"m{k}"), range(16)))
    assert len(set(held)) == 1


def test_artifacts_cases_and_fingerprints(spark, tmp_path):
    (tmp_path / "plot.txt").write_text("x")
    run = tracking.start_run(spark, tracking.create_experiment(spark, "artifacts"))
    place = tracking.log_artifact(spark, "artifacts", run, str(tmp_path / "plot.txt"))
    assert spark.read.text(place).first().value == "x"
    logged = tracking.get_run(spark, run).where("kind = 'artifact'").first()
    assert (logged.key, logged.value) == ("plot.txt", place)
    with pytest.raises(FileNotFoundError):
        tracking.log_artifact(spark, "artifacts", run, str(tmp_path / "none"))
    roles = spark.createDataFrame([("a", "boolean"), ("b", "boolean"), ("c", "identifier")], "column string, role string")
    fp = tracking.fingerprint(1_000, roles)
    assert fp == {"row_bucket": tracking.BUCKETS[1], "n_columns": 3, "role_mix": {"boolean": 2, "identifier": 1}}
    assert [tracking.row_bucket(n) for n in (0, 999, 9_999, 99_999, 100_000)] == [tracking.BUCKETS[k] for k in (0, 0, 1, 2, 3)]
    case = tracking.store_case(spark, fp, "classification", "linear", {"f1": 0.5})
    cases = spark.read.parquet(f"{store_dir(spark)}/tracking/cases.parquet")
    near = tracking.similar_cases(cases.where(F.col("id") == case), fp, "classification").first()
    assert (near.id, near.distance) == (case, 0.0)
