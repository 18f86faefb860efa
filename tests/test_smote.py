"""Made rows against a plain search of neighbours, and rows of which nothing can be made."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import model, smote

SCHEMA = "id long, a double, b double, c string, y int"


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    made = [(i, float(rng.normal()), float(rng.normal() * 5), "xy"[i % 2], 0 if i < 300 else 1 if i < 340 else 2) for i in range(350)]
    made += [(1000, made[305][1], made[305][2], "x", 1)]  # equal to another
    return spark.createDataFrame(made, SCHEMA).repartition(5).persist()


def test_rows_lie_between_near_neighbours(rows):
    out = smote.smote(rows, "y", "id", ["a", "b"])
    assert {r.y: r["count"] for r in out.groupBy("y").count().collect()} == {0: 300, 1: 300, 2: 300}
    assert out.where("not _made").exceptAll(rows.withColumn("_made", F.lit(False))).count() == 0
    made = out.where("_made").collect()
    assert len(made) == 259 + 290 and all(r.id is None and r.c is None for r in made)
    for label in (1, 2):
        x = np.array([(r.a, r.b) for r in rows.where(F.col("y") == label).collect()])
        apart = ((x[:, None] - x[None]) ** 2).sum(axis=2)
        np.fill_diagonal(apart, np.inf)
        near = np.argsort(apart, axis=1, kind="stable")[:, :5]
        ends = [(x[i], x[j]) for i in range(len(x)) for j in near[i]]
        for r in made:
            if r.y == label:
                p = np.array([r.a, r.b])
                assert any(abs(np.linalg.norm(p - a) + np.linalg.norm(p - b) - np.linalg.norm(a - b)) < 1e-9 for a, b in ends)


def test_neighbours_whatever_the_batches(rows, monkeypatch):
    one = rows.where("y = 1").select(F.lit("k").alias("class"), F.col("id").alias("pos"), "a", "b")
    want = sorted(map(str, smote.nearest(one, ["a", "b"]).collect()))
    monkeypatch.setattr(smote, "ROWS", 7)
    small = smote._neighbours(5)
    ordered = one.repartition(1).sort("a").select(F.lit("0|k").alias("group"), "class", "pos", F.array("a", "b").alias("x")).toArrow().to_batches()
    best = {}
    for batch in small(iter(ordered)):
        for r in batch.to_pylist():
            best.setdefault(r["pos"], set()).add((r["apart"], r["other"]))
    got = {pos: [o for _, o in sorted(met)[:5]] for pos, met in best.items()}
    assert sorted(f"Row(class='k', pos={p}, others={o})" for p, o in got.items()) == want


def test_large_classes_find_most_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3_000, 3))
    table = spark.createDataFrame([(0, i, *map(float, v)) for i, v in enumerate(x)], "class int, pos long, a double, b double, c double")
    found = {r.pos: r.others for r in smote.nearest(table, ["a", "b", "c"]).collect()}
    apart = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(apart, np.inf)
    near = np.sort(apart, axis=1)
    assert all(len(found[i]) == 5 for i in range(3_000))
    # Not always the nearest five, but rows a good deal nearer than others are.
    ratio = np.mean([np.sqrt(apart[i, found[i]].mean() / np.median(near[i, :2_999])) for i in range(3_000)])
    assert ratio < 0.35


def test_nothing_to_make(spark, rows):
    n = rows.count()
    assert smote.smote(rows, "y", "id", ["a", "c"]).count() == n  # a string
    assert smote.smote(rows.withColumn("a", F.when(F.col("id") == 5, None).otherwise(F.col("a"))), "y", "id", ["a", "b"]).count() == n
    assert smote.smote(rows.withColumn("a", F.when(F.col("id") == 5, float("nan")).otherwise(F.col("a"))), "y", "id", ["a", "b"]).count() == n
    assert smote.smote(rows.where("y = 0 or id = 345"), "y", "id", ["a", "b"]).count() == 301  # a class of one row
    empty = spark.createDataFrame([], SCHEMA)
    assert smote.smote(empty, "y", "id", ["a"]).count() == 0
    lost = rows.withColumn("y", F.when(F.col("id") % 2 == 0, F.col("y")))
    out = smote.smote(lost, "y", "id", ["a", "b"])
    assert out.where("y is null").count() == lost.where("y is null").count() and out.where("_made and y is null").count() == 0


def test_whole_numbers_and_equal_rows(spark):
    table = spark.createDataFrame([(i, 7 if i < 4 else i, i < 4) for i in range(20)], "id int, made int, y boolean")
    out = smote.smote(table, "y", "id", ["made"]).where("_made").collect()
    assert len(out) == 12 and {r.made for r in out} == {7} and all(r.y for r in out)


def test_folds_take_made_rows(rows):
    data = rows.where("y < 2").withColumn("fold", (F.col("id") % 2).cast("int"))
    train = model.balanced(data.where("fold = 0").drop("fold"), "y", "oversample_smote", "id", ["a", "b"])
    assert {r.y: r["count"] for r in train.groupBy("y").count().collect()} == {0: 150, 1: 150}
    scores = model.cross_validate(data, ["a", "b"], "y", "linear", "classification", imbalance="oversample_smote", key="id")
    assert scores.where("metric = 'accuracy'").count() == 2


@pytest.mark.parametrize(("classes", "each", "stretch"), [(800, 50, 20_000), (3, 900, 200)])
def test_whatever_the_partitions(spark, monkeypatch, classes, each, stretch):
    monkeypatch.setattr(smote, "TASK_ROWS", stretch)
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(classes, each)), 2)  # with ties
    table = spark.createDataFrame([(c, p, float(x[c, p])) for c in range(classes) for p in range(each)], "class int, pos long, a double")
    found = [{(r["class"], r.pos): r.others for r in smote.nearest(table.repartition(n), ["a"]).collect()} for n in (1, 3, 16)]
    assert found[0] == found[1] == found[2] and len(found[0]) == classes * each
    for c in range(0, classes, max(1, classes // 20)):
        apart = (x[c][:, None] - x[c][None]) ** 2
        np.fill_diagonal(apart, np.inf)
        for p in range(each):
            others = found[0][c, p]
            # One feature: the nearest lie around a row, so they are exact at any size, up to which of equal ones.
            assert np.allclose(np.sort(apart[p])[:5], apart[p, others]), (c, p)
            if each <= smote.SIDE + 1:
                assert others == sorted(range(each), key=lambda j: (apart[p, j], j))[:5]


def test_first_few_with_ties_beyond_them():
    """Of many equal distances those to the smallest places count, as by sorting all."""
    rng = np.random.default_rng(3)
    near = rng.integers(0, 4, (500, 128)).astype(float)
    near[:100] = rng.random((100, 128))
    near[100:120] = np.inf
    near[100:110, :3] = 1.0
    who = np.argsort(rng.random((500, 128)), axis=1)
    got, want = smote._first(near, lambda rows, columns: who[rows, columns], 5), np.lexsort((who, near), axis=1)[:, :5]
    rows = np.arange(500)[:, None]
    assert (near[rows, got] == near[rows, want]).all()
    known = np.isfinite(near[rows, want])
    assert (who[rows, got] == who[rows, want])[known].all()
