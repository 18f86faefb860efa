"""Quality by ordinal cumulative-link regression on graded ratings.

With one weight per hashed text feature, shared by all grades, and ordered thresholds t1 < t2 < ...,
P(grade >= k) = sigmoid(z - tk), where z is the weighted sum of a text's features: the shares of its
1- to 3-grams of bytes, and the bins that a few counts of the whole text fall into. The expected grade
is the sum of these tails. Weights and thresholds are learnt together in numpy from a bounded sample of
rated documents (SAMPLE rows, the first by a hash of the id) of any length: of a text with more than SAMPLE_GRAMS
distinct n-grams so many are drawn by a hash. Scoring reads
whole texts, once, where they lie, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.bytekit import BYTE_VALUE, NOT_SPACE, mix, prefix_hash, span_hash, words
from tabloom.llm.docmap import add_columns
from tabloom.llm.toxicity import drawn

BUCKETS = 1 << 16
SAMPLE = 6_000
SAMPLE_GRAMS = 8_000
#: As many passes over the sample as make UPDATES steps of BATCH documents.
UPDATES, BATCH, RATE, DECAY = 1_875, 64, 0.1, 1e-5
#: What all n-grams of a text weigh together, beside each of its bins at 1.
GRAM_WEIGHT = 20.0

_code = np.arange(256)
_KINDS = {
    "upper": (_code >= 65) & (_code <= 90),
    "lower": (_code >= 97) & (_code <= 122),
    "digit": (_code >= 48) & (_code <= 57),
    "high": _code >= 128,
    "symbol": ((_code >= 33) & (_code <= 47)) | ((_code >= 58) & (_code <= 64)) | ((_code >= 91) & (_code <= 96)) | ((_code >= 123) & (_code <= 126)),
}


def _grams(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of bytes that lie within a document, and their documents."""
    size = np.diff(off)
    doc = np.repeat(np.arange(len(size)), size)
    at = np.flatnonzero(np.arange(len(data)) + n <= off[1:][doc]) if len(data) else np.zeros(0, np.int64)
    h = np.full(len(at), np.uint64(n), np.uint64)
    for j in range(n):
        h = h * np.uint64(0xD6E8FEB86659FD93) + BYTE_VALUE[data[at + j]]
    return ((mix(h) >> np.uint64(20)) % np.uint64(BUCKETS)).astype(np.int64), doc[at]


def bins(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(n, bins) buckets of the counts of whole texts: shares of kinds of bytes, mean length of words,
    share of distinct words, and number of words."""
    size = np.diff(off)
    some = np.maximum(size, 1)
    columns = []
    for member in _KINDS.values():
        total = np.concatenate(([0], np.cumsum(member[data])))
        columns.append(np.minimum(20 * (total[off[1:]] - total[off[:-1]]) // some, 20))
    starts, ends, at = words(data, off, NOT_SPACE)
    n_words = np.diff(at)
    of_word = np.repeat(np.arange(len(size)), n_words)
    hashes = span_hash(prefix_hash(data), starts, ends) if len(starts) else np.zeros(0, np.uint64)
    by = np.lexsort((hashes, of_word))
    first = np.append(True, (np.diff(of_word[by]) != 0) | (hashes[by][1:] != hashes[by][:-1]))[: len(by)]
    distinct = np.bincount(of_word[by][first], minlength=len(size))
    columns.append(np.minimum(size // np.maximum(n_words, 1), 20))
    columns.append(20 * distinct // np.maximum(n_words, 1))
    columns.append(np.log2(n_words + 1).astype(np.int64))
    key = np.stack([np.int64(1000 * (i + 1)) + c for i, c in enumerate(columns)], axis=1)
    return (mix(key.astype(np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray
    #: Ascending; one fewer than the grades 0, 1, ...
    thresholds: np.ndarray


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def fit(ids: list[np.ndarray], values: list[np.ndarray], grades: np.ndarray, top: int, seed: int = 3) -> Model:
    """Adagrad on the likelihood of grades 0..top. Thresholds are the first and the logs of the steps
    to the next ones, so they stay in order."""
    rng = np.random.default_rng(seed)
    weights, seen = np.zeros(BUCKETS), np.full(BUCKETS, 1e-3)
    share = [np.clip((grades > k).mean(), 0.01, 0.99) for k in range(top)]
    start = np.log((1 - np.array(share)) / np.array(share))
    first, steps = start[0], np.log(np.maximum(np.diff(start), 0.05))
    seen_t = np.full(top, 1e-3)
    for _ in range(-(-UPDATES * BATCH // max(len(grades), BATCH))):
        order = rng.permutation(len(grades))
        for begin in range(0, len(order), BATCH):
            rows = order[begin : begin + BATCH]
            sizes = np.array([len(ids[r]) for r in rows])
            flat, value = np.concatenate([ids[r] for r in rows]), np.concatenate([values[r] for r in rows])
            doc = np.repeat(np.arange(len(rows)), sizes)
            z = np.bincount(doc, weights[flat] * value, len(rows))
            edges = np.concatenate(([-np.inf], first + np.concatenate(([0.0], np.cumsum(np.exp(steps)))), [np.inf]))
            y = grades[rows]
            low, high = edges[y], edges[y + 1]
            a, b = np.where(np.isinf(low), 0.0, _sigmoid(low - z)), np.where(np.isinf(high), 1.0, _sigmoid(high - z))
            p = np.maximum(b - a, 1e-9)
            da, db = a * (1 - a) / p, b * (1 - b) / p  # of the loss by the two edges: +da, -db
            grad_z = (db - da) / len(rows)
            grad_edge = (np.bincount(y, da, top + 1)[1:] - np.bincount(y, db, top + 1)[:-1]) / len(rows)
            by = np.argsort(flat, kind="stable")
            used, heads = np.unique(flat[by], return_index=True)
            grad_w = np.add.reduceat((grad_z[doc] * value)[by], heads) + DECAY * weights[used]
            seen[used] += grad_w**2
            weights[used] -= RATE * grad_w / np.sqrt(seen[used])
            tails = np.cumsum(grad_edge[::-1])[::-1]
            grad_t = np.concatenate(([tails[0]], tails[1:] * np.exp(steps)))
            seen_t += grad_t**2
            moved = RATE * grad_t / np.sqrt(seen_t)
            first, steps = first - moved[0], np.clip(steps - moved[1:], -10, 5)
    return Model(weights.astype(np.float32), first + np.concatenate(([0.0], np.cumsum(np.exp(steps)))))


def _features(data: np.ndarray, off: np.ndarray, rows: pa.RecordBatch) -> list[pa.Array]:
    n = len(off) - 1
    parts = [_grams(data, off, k) for k in (1, 2, 3)]
    bucket, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
    both, count = np.unique(doc * BUCKETS + bucket, return_counts=True)
    keep = drawn(both // BUCKETS, both % BUCKETS, SAMPLE_GRAMS, data, off)
    both, count = both[keep], count[keep]
    total = np.bincount(both // BUCKETS, count, n)
    value = GRAM_WEIGHT * count / total[both // BUCKETS]
    extra = bins(data, off)
    doc = np.concatenate((both // BUCKETS, np.repeat(np.arange(n), extra.shape[1])))
    bucket, value = np.concatenate((both % BUCKETS, extra.ravel())), np.concatenate((value, np.ones(extra.size)))
    by = np.argsort(doc, kind="stable")
    at = pa.array(np.searchsorted(doc[by], np.arange(n + 1), "left").astype(np.int32))
    return [pa.ListArray.from_arrays(at, pa.array(bucket[by].astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(value[by].astype(np.float32)))]


BAG = [T.StructField("buckets", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.FloatType()))]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, ratings: DataFrame, grade: str = "grade", top: int = 2, doc_id: str = "doc_id", text: str = "text") -> Model:
    """A model of grades 0..top learnt from rated documents that are not held out, SAMPLE at
    most. Grades outside, and null ids, grades and texts, teach nothing. Without
    rated documents the weights are 0 and the thresholds -1, 0, 1, ..."""
    known = ratings.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{grade}`").cast("int").alias("y")).where(F.col("y").between(0, top))
    texts = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).where(F.octet_length("text") > 0)
    usable = known.where(~held_out("id")).groupBy("id").agg(F.max("y").alias("y")).join(texts.select("id"), "id", "left_semi")
    picked = usable.orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    sample = texts.join(F.broadcast(picked), "id").groupBy("id", "y").agg(F.min("text").alias("text"))  # SAMPLE rows at most
    rows = add_columns(sample, _features, BAG, drop=("text",)).orderBy("id").toArrow()
    if not rows.num_rows:
        return Model(np.zeros(BUCKETS, np.float32), np.arange(top) - 1.0)
    ids, values = ([np.asarray(v.values.to_numpy()) for v in rows.column(c)] for c in ("buckets", "values"))
    return fit(ids, values, rows.column("y").to_numpy().astype(np.int64), top)


def tails(docs: DataFrame, model: Model, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with expected_grade and the array tail, P(grade >= 1), P(grade >= 2), ..., by the whole text,
    in place of columns of these names. Null texts count as empty ones."""
    fields = [T.StructField("expected_grade", T.DoubleType()), T.StructField("tail", T.ArrayType(T.DoubleType()))]
    weights, thresholds = model.weights, model.thresholds

    def kernel(data: np.ndarray, off: np.ndarray, rows: pa.RecordBatch) -> list[pa.Array]:
        n = len(off) - 1
        total, count = np.zeros(n), np.zeros(n)
        for k in (1, 2, 3):
            bucket, doc = _grams(data, off, k)
            total += np.bincount(doc, weights[bucket], n)
            count += np.bincount(doc, minlength=n)
        z = GRAM_WEIGHT * total / np.maximum(count, 1) + weights[bins(data, off)].sum(axis=1)
        p = _sigmoid(z[:, None] - thresholds)
        at = pa.array((np.arange(n + 1) * len(thresholds)).astype(np.int32))
        return [pa.array(p.sum(axis=1)), pa.ListArray.from_arrays(at, pa.array(p.ravel()))]

    return add_columns(docs, kernel, fields, text, drop)


def grade_quality(docs: DataFrame, ratings: DataFrame, least: int = 1, sure: float = 0.5, top: int = 2) -> DataFrame:
    """(doc_id, held_out, expected_grade, tail, kept) for every row of docs; tail is P(grade >= least), and
    kept tells whether it is `sure` or more. A row's own rating, and its id, play no part in its grade.
    Rows with null ids are not held out; repeated rows are graded one by one. An empty table gives no rows."""
    rows = docs.select("doc_id", F.col("text").alias("_text"))
    graded = tails(rows, train(docs, ratings, top=top), "_text", drop=("_text",))
    tail = F.element_at("tail", least)
    return graded.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "expected_grade", tail.alias("tail"), (tail >= sure).alias("kept"))
