"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A document is the average of the vectors of its words and of their character 3- to 5-grams (marked
where they touch a word's edge), hashed into BUCKETS rows; a linear softmax reads that average. Vectors
and softmax are trained jointly in numpy, so an unseen misspelling is near the word it shares n-grams
with. Training takes a bounded sample of labelled documents (SAMPLE_PER_CLASS of each class, the first by a hash of the id) of any
length; of a text with more than SAMPLE_GRAMS distinct n-grams so many are drawn, by a hash of the text. Since the average is linear, the trained model is one
number per bucket: scoring reads whole texts, once, where they lie, without a shuffle.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.bytekit import ALNUM, LOWER, mix, prefix_hash, ranges, span_hash, words
from tabloom.llm.docmap import add_columns

BUCKETS = 1 << 18
DIMENSION = 8
GRAMS = (3, 4, 5)
SAMPLE_PER_CLASS = 2_000
SAMPLE_GRAMS = 8_000
#: As many passes over the sample as make UPDATES steps of BATCH documents.
UPDATES, BATCH, RATE, DECAY = 750, 64, 0.05, 1e-6

_EDGES = np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def subwords(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and their character n-grams, document by document within each n, and the
    document of each."""
    data = LOWER[data]
    starts, ends, at = words(data, off, ALNUM)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sums = prefix_hash(data)
    of_word = np.repeat(np.arange(len(off) - 1), np.diff(at))
    found, docs = [span_hash(sums, starts, ends)], [of_word]
    size = ends - starts
    for n in GRAMS:
        count = np.maximum(size - n + 1, 0)
        if n > GRAMS[0]:
            count[size == n] = 0  # the whole word has its bucket already
        place = ranges(starts, count)
        if len(place):
            word = np.repeat(np.arange(len(starts)), count)
            edge = (place == starts[word]).astype(np.int64) + 2 * (place + n == ends[word])
            found.append(span_hash(sums, place, place + n) ^ _EDGES[edge])
            docs.append(of_word[word])
    hashes = np.concatenate(found)
    return ((hashes >> np.uint64(20)) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(docs)


def fit(ids: list[np.ndarray], counts: list[np.ndarray], labels: np.ndarray, prior: float, seed: int = 11) -> tuple[np.ndarray, float]:
    """(weight of each bucket, bias) of the log odds of label 1, by Adagrad on documents given as
    distinct buckets with counts. The classes' share in the sample is replaced by `prior`."""
    rng = np.random.default_rng(seed)
    vectors = (rng.random((BUCKETS, DIMENSION), np.float32) - np.float32(0.5)) / np.float32(DIMENSION)
    softmax = rng.standard_normal((DIMENSION, 2)).astype(np.float32) * np.float32(0.1)
    bias = np.zeros(2, np.float32)
    seen_v, seen_s, seen_b = np.full(BUCKETS, 1e-3, np.float32), np.full_like(softmax, 1e-3), np.full_like(bias, 1e-3)
    shares = [(c / max(c.sum(), 1)).astype(np.float32) for c in counts]
    scale = np.float32(100.0)  # averages of thousands of n-grams are small
    for _ in range(-(-UPDATES * BATCH // max(len(labels), BATCH))):
        order = rng.permutation(len(labels))
        for first in range(0, len(order), BATCH):
            rows = order[first : first + BATCH]
            sizes = np.array([len(ids[r]) for r in rows])
            if not sizes.sum():
                continue
            flat, share = np.concatenate([ids[r] for r in rows]), np.concatenate([shares[r] for r in rows])
            doc = np.repeat(np.arange(len(rows)), sizes)
            mean = np.zeros((len(rows), DIMENSION), np.float32)
            some = np.flatnonzero(sizes)
            cuts = (np.cumsum(sizes) - sizes)[some]
            mean[some] = np.add.reduceat(vectors[flat] * share[:, None], cuts, axis=0) * scale
            out = mean @ softmax + bias
            p = np.exp(out - out.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), labels[rows]] -= 1
            p /= len(rows)
            grad_mean = (p @ softmax.T) * scale
            by = np.argsort(flat, kind="stable")
            buckets, heads = np.unique(flat[by], return_index=True)
            grad_v = np.add.reduceat(grad_mean[doc[by]] * share[by, None], heads, axis=0) + np.float32(DECAY) * vectors[buckets]
            grad_s, grad_b = mean.T @ p, p.sum(axis=0)
            seen_v[buckets] += (grad_v**2).mean(axis=1)
            vectors[buckets] -= np.float32(RATE) * grad_v / np.sqrt(seen_v[buckets])[:, None]
            seen_s += grad_s**2
            softmax -= np.float32(RATE) * grad_s / np.sqrt(seen_s)
            seen_b += grad_b**2
            bias -= np.float32(RATE) * grad_b / np.sqrt(seen_b)
    share1 = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(labels) else 0.5
    shift = np.log(prior / (1 - prior)) - np.log(share1 / (1 - share1))
    weight = (vectors @ (softmax[:, 1] - softmax[:, 0])) * scale
    return weight.astype(np.float32), float(bias[1] - bias[0] + shift)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % 5 == 0


def drawn(doc: np.ndarray, bucket: np.ndarray, most: int, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which of the distinct (document, bucket) entries, in order, stay: `most` of each document, by a hash of its text and the
    bucket, so wherever and in whatever company the document is read."""
    texts = [blake2b(data[s:e].tobytes(), digest_size=8).digest() for s, e in zip(off[:-1], off[1:], strict=True)]
    chance = mix((bucket.astype(np.uint64) << np.uint64(20)) ^ np.frombuffer(b"".join(texts), "<u8")[doc])
    by = np.lexsort((chance, doc))
    head = np.flatnonzero(np.append(True, np.diff(doc[by]) != 0)) if len(doc) else np.zeros(0, np.int64)
    place = np.arange(len(doc)) - np.repeat(head, np.diff(np.append(head, len(doc))))
    keep = np.zeros(len(doc), bool)
    keep[by[place < most]] = True
    return keep


def _bag(data: np.ndarray, off: np.ndarray, rows: pa.RecordBatch) -> list[pa.Array]:
    bucket, doc = subwords(data, off)
    both, count = np.unique(doc * BUCKETS + bucket, return_counts=True)
    keep = drawn(both // BUCKETS, both % BUCKETS, SAMPLE_GRAMS, data, off)
    both, count = both[keep], count[keep]
    at = np.searchsorted(both, np.arange(len(off)) * BUCKETS, "left").astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(v, pa.int32())) for v in ((both % BUCKETS).astype(np.int32), count.astype(np.int32))]
    return lists


BAG = [T.StructField("buckets", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.IntegerType()))]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text") -> tuple[np.ndarray, float]:
    """A model learnt from labelled documents that are not held out: at most SAMPLE_PER_CLASS of each
    class. Null labels, ids and texts teach nothing. Without a document
    of either class the score is the share of label 1 among all (0.5 without labels)."""
    known = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).where("y in (0, 1)")
    known = known.where(~held_out("id"))
    shares = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    prior = (shares.get(1, 0) + 1) / (sum(shares.values()) + 2)
    texts = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).where(F.octet_length("text") > 0)
    usable = known.join(texts.select("id"), "id", "left_semi").withColumn("h", F.xxhash64("id"))
    picked = [usable.where(F.col("y") == y).orderBy("h", "id").limit(SAMPLE_PER_CLASS) for y in (0, 1)]
    picked = picked[0].union(picked[1]).groupBy("id").agg(F.max("y").alias("y"))
    sample = texts.join(F.broadcast(picked), "id").groupBy("id", "y").agg(F.min("text").alias("text"))  # at most 2 * SAMPLE_PER_CLASS rows
    rows = add_columns(sample, _bag, BAG, drop=("text",)).orderBy("id").toArrow()
    y = rows.column("y").to_numpy().astype(np.int64)
    if len(np.unique(y)) < 2:
        return np.zeros(BUCKETS, np.float32), float(np.log(prior / (1 - prior)))
    ids, counts = ([np.asarray(v.values.to_numpy()) for v in rows.column(c)] for c in ("buckets", "counts"))
    return fit(ids, counts, y, prior)


SCORE = [T.StructField("score", T.DoubleType())]


def score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with the column score, the probability of label 1 by the whole text, in place of one of that
    name. Texts without words, empty and null ones have the score of the bias alone."""
    weight, bias = model

    def kernel(data: np.ndarray, off: np.ndarray, rows: pa.RecordBatch) -> list[pa.Array]:
        bucket, doc = subwords(data, off)
        n = len(off) - 1
        total = np.bincount(doc, weight[bucket], n) / np.maximum(np.bincount(doc, minlength=n), 1)
        return [pa.array(1 / (1 + np.exp(-np.clip(total + bias, -50, 50))))]

    return add_columns(docs, kernel, SCORE, text, drop)


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs; a row's own label, and its id, play no
    part in its score. Rows with null ids are not held out. An empty table gives no rows."""
    model = train(docs, labels, doc_id=doc_id, text=text)
    scored = score(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("_text")), model, "_text", drop=("_text",))
    out = F.coalesce(held_out("doc_id"), F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, most: float = 0.5) -> DataFrame:
    """docs, with their columns, whatever their names, that score below `most`. Null and empty texts score as the bias
    alone says; repeated rows are judged one by one, and an empty table gives none."""
    names = docs.columns
    kept = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), F.col("text").alias("_text"))
    return score(kept, train(docs, labels), "_text", drop=("_text",)).where(F.col("score") < most).select("_row.*")
