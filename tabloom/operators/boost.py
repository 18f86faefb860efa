"""Gradient boosting of several classes: softmax gradients, one tree a class and round, grown level by level.

Features are cut into bins once, by quantiles. A level of the trees of all classes is one aggregation: each task adds up
gradients, curvatures and rows by class, node, feature and bin, and these sums, whose number depends on trees and bins but
not on rows, are added over tasks. Best splits of the sums reach the driver, a row a node. Scores of rows are carried in a
table that is written anew every KEEP rounds, so a lost task computes a few rounds again and not all."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators.ranges import quantiles
from tabloom.sources.tables import store_dir

#: Bins of a feature's known values; missing ones have one more.
BINS = 32
#: Rounds between two tables of scores.
KEEP = 10


class _Options(HasFeaturesCol, HasLabelCol):
    rounds = Param(Params._dummy(), "rounds", "trees of each class", TypeConverters.toInt)
    depth = Param(Params._dummy(), "depth", "levels of splits of a tree", TypeConverters.toInt)
    rate = Param(Params._dummy(), "rate", "share of a leaf's step that is taken", TypeConverters.toFloat)
    leastRows = Param(Params._dummy(), "leastRows", "rows of a leaf, at least", TypeConverters.toInt)


def _place(trees: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """The node that each row comes to. A tree is rows (feature, bin, missing goes left) by node, root 1 and children 2 n and 2 n + 1;
    feature -1 stops there."""
    node = np.ones(len(bins), np.int64)
    rows = np.arange(len(bins))
    while True:
        feature, cut, left = trees[node].T
        going = feature >= 0
        if not going.any():
            return node
        value = bins[rows, np.maximum(feature, 0)]
        right = np.where(value == BINS, left == 0, value > cut)
        node = np.where(going, 2 * node + right, node)


def _raise(raw: np.ndarray, rounds: list, bins: np.ndarray) -> np.ndarray:
    """Scores after further rounds, each a list of (tree, values of its nodes) by class."""
    raw = raw.copy()
    for trees in rounds:
        for k, (tree, values) in enumerate(trees):
            raw[:, k] += values[_place(tree, bins)]
    return raw


def softmax(raw: np.ndarray) -> np.ndarray:
    p = np.exp(raw - raw.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _sums(state: DataFrame, pending: list, trees: list[np.ndarray], level: int, features: int, classes: int) -> DataFrame:
    """(slot, sums): for each class, node of the level and feature, the sums of gradient, curvature and rows by bin."""
    nodes, width = 1 << level, 3 * (BINS + 1)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((classes, nodes * features, 3, BINS + 1))
        for batch in batches:
            bins, raw = _matrix(batch.column("bins"), np.uint8, features), _matrix(batch.column("raw"), np.float64, classes)
            p, y = softmax(_raise(raw, pending, bins)), batch.column("y").to_numpy()
            for k in range(classes):
                at = _place(trees[k], bins) - nodes
                here = np.flatnonzero(at >= 0)
                slope, bend = p[here, k] - (y[here] == k), p[here, k] * (1 - p[here, k])
                cell = ((at[here, None] * features + np.arange(features)) * (BINS + 1) + bins[here]).ravel()
                for j, x in enumerate((slope, bend, np.ones(len(here)))):
                    total[k, :, j] += np.bincount(cell, np.repeat(x, features), nodes * features * (BINS + 1)).reshape(-1, BINS + 1)
        flat = total.reshape(-1, width)
        some = np.flatnonzero(flat.any(axis=1))
        part = TaskContext.get().partitionId()
        for at in range(0, len(some), 10_000):
            chosen = some[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(chosen), pa.array([part] * len(chosen), pa.int32()), pa.array([flat[s].tobytes() for s in chosen], pa.binary())], names=["slot", "part", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["slot", "sums"])
        for batch in batches:
            for slot, sums in zip(batch.column("slot").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                if slot != now:
                    if now is not None:
                        yield row()
                    now, total = slot, np.zeros(width)
                total = total + np.frombuffer(sums)
        if now is not None:
            yield row()

    # Parts are added in their order, so sums don't depend on which task came first.
    return state.mapInArrow(partial, "slot long, part int, sums binary").repartition("slot").sortWithinPartitions("slot", "part").mapInArrow(added, "slot long, sums binary")


def _splits(sums: DataFrame, features: int, least: int) -> DataFrame:
    """(slot of class and node, feature, gain, cut, left, g, h): the best split of each node; gain 0 where none is allowed."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for slot, data in zip(batch.column("slot").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                g, h, n = np.frombuffer(data).reshape(3, BINS + 1)
                total = np.array([g.sum(), h.sum(), n.sum()])
                top = (0.0, 0, 1)
                for left in (1, 0):
                    side = np.cumsum(np.stack([g, h, n])[:, :BINS], axis=1) + left * np.stack([g, h, n])[:, BINS:]
                    other = total[:, None] - side
                    with np.errstate(divide="ignore", invalid="ignore"):
                        gain = side[0] ** 2 / side[1] + other[0] ** 2 / other[1] - total[0] ** 2 / total[1]
                    gain[(side[2] < least) | (other[2] < least) | ~np.isfinite(gain)] = 0
                    k = int(np.argmax(gain))
                    if gain[k] > top[0] + 1e-12:
                        top = (float(gain[k]), k, left)
                out.append((slot // features, slot % features, *top, float(total[0]), float(total[1])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["node", "feature", "gain", "cut", "left", "g", "h"])

    each = sums.mapInArrow(best, "node long, feature long, gain double, cut long, left long, g double, h double")
    # Gains that differ in the last digits only are ties, which the first feature wins.
    order = F.struct(F.round("gain", 9), -F.col("feature"))
    return each.groupBy("node").agg(F.max_by(F.struct("feature", "gain", "cut", "left"), order).alias("s"), F.min_by("g", "feature").alias("g"), F.min_by("h", "feature").alias("h")).select("node", "s.*", "g", "h")


class SoftmaxBoost(Estimator, _Options):
    """Estimator of a vector column and labels 0, 1, ...; rows without a label don't count, missing features may go either way."""

    def __init__(self, labelCol: str = "label", featuresCol: str = "features", rounds: int = 200, depth: int = 5, rate: float = 0.1, leastRows: int = 20):
        super().__init__()
        self._setDefault(rounds=200, depth=5, rate=0.1, leastRows=20)
        self._set(labelCol=labelCol, featuresCol=featuresCol, rounds=rounds, depth=depth, rate=rate, leastRows=leastRows)

    def _fit(self, dataset: DataFrame) -> SoftmaxBoostModel:
        depth, rate = self.getOrDefault("depth"), self.getOrDefault("rate")
        spark, label = dataset.sparkSession, F.col(f"`{self.getLabelCol()}`")
        rows = dataset.where(label.isNotNull()).select(vector_to_array(F.col(f"`{self.getFeaturesCol()}`")).alias("x"), label.cast("int").alias("y"))
        counts = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
        if not counts or min(counts) < 0:
            raise ValueError("labels are to be 0, 1, ...")
        classes, features = max(counts) + 1, rows.select(F.size("x")).first()[0]
        edges = bin_edges(rows, features)
        prior = np.log(np.array([max(counts.get(k, 0), 1e-9) for k in range(classes)]) / sum(counts.values()))
        model = SoftmaxBoostModel(edges, prior, [])
        self._copyValues(model)

        folder = f"{store_dir(spark)}/boost/{uuid.uuid4().hex}"
        state = _kept(_binned(rows, edges, prior), f"{folder}/0")
        try:
            pending: list = []
            for r in range(self.getOrDefault("rounds")):
                trees = [np.full((2 << depth, 3), -1, np.int64) for _ in range(classes)]
                values = [np.zeros(2 << depth) for _ in range(classes)]
                for level in range(depth + 1):
                    nodes, grown = 1 << level, False
                    for s in _splits(_sums(state, pending, trees, level, features, classes), features, self.getOrDefault("leastRows")).collect():
                        k, node = s.node // nodes, nodes + s.node % nodes
                        values[k][node] = -rate * s.g / s.h if s.h > 0 else 0.0
                        if level < depth and s.gain > 0:
                            trees[k][node], grown = (s.feature, s.cut, s.left), True
                    if not grown:
                        break
                pending.append(list(zip(trees, values, strict=True)))
                model.rounds_.append(pending[-1])
                if len(pending) == KEEP:
                    state, pending = _kept(_advanced(state, pending, features, classes), f"{folder}/{r + 1}"), []
        finally:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        return model


def bin_edges(rows: DataFrame, features: int) -> list[list[float]]:
    """Inner edges of each feature's bins: distinct quantiles of its known values; a value is in the bin of the first edge that is
    not below it."""
    known = rows.select(*(F.nullif(F.col("x")[k], F.lit(float("nan"))).alias(f"f{k}") for k in range(features)))
    found = quantiles(known, known.columns, [k / BINS for k in range(1, BINS)])
    return [sorted(set(found[c] or [])) for c in known.columns]


def _cells(x: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    out = np.empty(x.shape, np.uint8)
    for k, cuts in enumerate(edges):
        out[:, k] = np.where(np.isnan(x[:, k]), BINS, np.searchsorted(np.array(cuts), x[:, k]))
    return out


def _binned(rows: DataFrame, edges: list[list[float]], prior: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([[np.nan if v is None else v for v in r] for r in batch.column("x").to_pylist()], np.float64).reshape(batch.num_rows, len(edges))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in _cells(x, edges)], pa.binary()), batch.column("y"), pa.array([prior.tobytes()] * batch.num_rows, pa.binary())], names=["bins", "y", "raw"])

    return rows.mapInArrow(run, "bins binary, y int, raw binary")


def _advanced(state: DataFrame, pending: list, features: int, classes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = _raise(_matrix(batch.column("raw"), np.float64, classes), pending, _matrix(batch.column("bins"), np.uint8, features))
            yield pa.RecordBatch.from_arrays([batch.column("bins"), batch.column("y"), pa.array([r.tobytes() for r in raw], pa.binary())], names=["bins", "y", "raw"])

    return state.mapInArrow(run, "bins binary, y int, raw binary")


def _kept(state: DataFrame, path: str) -> DataFrame:
    state.write.parquet(path)
    return state.sparkSession.read.parquet(path)


class SoftmaxBoostModel(Model, _Options, MLWritable, MLReadable):
    """Adds rawPrediction, probability (vectors) and prediction (the class of the largest score, the first of equal ones)."""

    def __init__(self, edges: list[list[float]] | None = None, prior: np.ndarray | None = None, rounds: list | None = None):
        super().__init__()
        self.edges, self.prior, self.rounds_ = edges or [], np.zeros(0) if prior is None else prior, rounds or []

    @property
    def numClasses(self) -> int:
        return len(self.prior)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        edges, prior, rounds = self.edges, self.prior, self.rounds_

        @F.pandas_udf("array<double>")
        def raw(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for x in batches:
                bins = _cells(np.array([[np.nan if v is None else v for v in r] for r in x], np.float64).reshape(len(x), len(edges)), edges)
                yield pd.Series(list(_raise(np.tile(prior, (len(x), 1)), rounds, bins)))

        out = dataset.withColumn("_raw", raw(vector_to_array(F.col(f"`{self.getFeaturesCol()}`"))))
        top = F.array_max("_raw")
        up = F.transform("_raw", lambda r: F.exp(r - top))
        share = F.transform(up, lambda e: e / F.aggregate(up, F.lit(0.0), lambda s, x: s + x))
        place = (F.array_position("_raw", top) - 1).cast("double")
        return out.withColumns({"rawPrediction": array_to_vector("_raw"), "probability": array_to_vector(share), "prediction": place}).drop("_raw")

    def write(self) -> MLWriter:
        return _BoostWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _BoostReader()


class _BoostWriter(MLWriter):
    def __init__(self, model: SoftmaxBoostModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m = self.model
        rounds = [[[t.tolist(), v.tolist()] for t, v in trees] for trees in m.rounds_]
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata={"edges": m.edges, "prior": m.prior.tolist()})
        rows = [(k, json.dumps(r)) for k, r in enumerate(rounds)]
        self.sparkSession.createDataFrame(rows, "round int, trees string").write.parquet(f"{path}/rounds")


class _BoostReader(MLReader):
    def load(self, path: str) -> SoftmaxBoostModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        rows = self.sparkSession.read.parquet(f"{path}/rounds").orderBy("round").collect()
        rounds = [[(np.array(t, np.int64), np.array(v)) for t, v in json.loads(r.trees)] for r in rows]
        model = SoftmaxBoostModel(metadata["edges"], np.array(metadata["prior"]), rounds)
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
