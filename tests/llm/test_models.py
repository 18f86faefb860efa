import math
import random
import re
import zlib

import numpy as np
import pytest

from tabloom.llm import bytekit, quality, queries
from tabloom.llm import toxicity as tox
from tabloom.llm.quality import grade_quality
from tabloom.llm.quantise import search
from tabloom.llm.toxicity import drop_toxic, toxicity

SF = "/root/testdata/sf0.01"


def test_toxicity_on_held_out_labels(spark):
    rows = {r.doc_id: r for r in queries.op7_toxicity(spark, SF).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for d, r in rows.items())
    held = [(rows[d].score, y) for d, y in labels.items() if rows[d].held_out]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([a > b for a in pos for b in neg]) > 0.85


def test_quality_on_held_out_labels(spark):
    rows = {r.doc_id: r for r in queries.op5_quality(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(rows[d].kept, y) for d, y in labels.items() if rows[d].held_out]
    assert np.mean([k == bool(y) for k, y in held]) > 0.9
    assert all(r.tail <= r.expected_grade <= 2 for r in rows.values())


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, 3.0), (2, "", 3.0), (None, "abc", 3.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert [r.score for r in toxicity(docs, labels).collect()] == pytest.approx([0.5] * 3)
    assert drop_toxic(docs, labels, most=0.6).columns == docs.columns
    assert toxicity(docs.limit(0), labels).count() == 0


def test_neighbours_recall(spark):
    got = {}
    for r in queries.op10_neighbours(spark, SF).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    hits = 0
    for q, v in rows:
        if q % 100 == 0:
            near = sorted((float(np.sqrt(((v - w) ** 2).sum())), i) for i, w in rows if i != q)[:10]
            mine = sorted(got[q])
            assert [r for r, _, _ in mine] == list(range(1, 11)) and [(s, i) for _, i, s in mine] == sorted((s, i) for _, i, s in mine)
            hits += len({i for _, i, _ in mine} & {i for _, i in near})
            exact = dict((i, d) for d, i in near)
            assert all(s == pytest.approx(exact[i], rel=1e-12) for _, i, s in mine if i in exact)
    assert hits >= 0.9 * 10 * len(got)


def test_neighbours_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0]), (8, [None, 1.0]), (2, [1.0, 1.0]), (None, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = search(df, df.where("vec_id = 0"), k=10).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(out, key=lambda r: r.rank)] == [(0, 1, 1, 0.0), (0, 2, 2, 1.0)]
    assert search(df, df.where("vec_id = 3")).count() == 0
    assert search(df.limit(0), df.limit(0)).count() == 0


def test_neighbours_ties_and_clashing_names(spark):
    """More equal vectors than are ranked again: the smallest ids win; other columns play no part."""
    rows = [(i, [1.0, 0.0], i, "x", 0.0) for i in range(400)] + [(1000, [0.0, 3.0], 0, "x", 0.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id long, code string, score double")
    out = sorted(search(df, df.where("vec_id in (0, 1000)")).collect(), key=lambda r: (r.query_id, r.rank))
    assert [r.vec_id for r in out if r.query_id == 0] == list(range(1, 11))
    assert [(r.vec_id, r.score) for r in out if r.query_id == 1000] == [(i, math.sqrt(10)) for i in range(10)]


def test_neighbours_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr("tabloom.llm.quantise.BLOCK_QUERIES", 4)
    monkeypatch.setattr("tabloom.llm.quantise.BLOCKS_AT_ONCE", 2)
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(120, 6)).tolist()
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    odd = spark.createDataFrame([(500 + i, [1.0]) for i in range(60)], df.schema)
    out = search(df, df.where("vec_id % 6 = 0").union(odd), k=3).collect()  # most queries have another length; the table's counts
    assert {(r.query_id, r.rank) for r in out} == {(q, k) for q in range(0, 120, 6) for k in (1, 2, 3)}


MASK = (1 << 64) - 1


def mix(x):
    x = ((x ^ (x >> 33)) * 0xFF51AFD7ED558CCD) & MASK
    x = ((x ^ (x >> 33)) * 0xC4CEB9FE1A85EC53) & MASK
    return x ^ (x >> 33)


def span(raw):
    total, power = 0, 1
    for b in raw:
        total, power = (total + int(bytekit.BYTE_VALUE[b]) * power) & MASK, (power * int(bytekit.BASE)) & MASK
    return mix((total + len(raw)) & MASK)


TEXTS = ["You absolut idiot!", "", "Ünïcode wörds, 123 and x", "a", "the same the same the same", "  ", "Long " * 3000, "ab abc abcd abcde abcdef"]


def test_toxicity_scores_by_plain_loops(spark):
    rng = np.random.default_rng(1)
    weight, bias = rng.normal(size=tox.BUCKETS).astype(np.float32), 0.25
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    got = {r.i: r.score for r in tox.score(df, (weight, bias)).collect()}
    for i, text in enumerate(TEXTS):
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
        found = []
        for word in re.findall(rb"[0-9a-z\x80-\xff]+", raw):
            found.append((span(word) >> 20) % tox.BUCKETS)
            for n in (3, 4, 5):
                for at in range(len(word) - n + 1 if n == 3 or len(word) != n else 0):
                    edge = (at == 0) + 2 * (at + n == len(word))
                    found.append(((span(word[at : at + n]) ^ int(tox._EDGES[edge])) >> 20) % tox.BUCKETS)
        mean = sum(float(weight[b]) for b in found) / max(len(found), 1)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-mean - bias)), rel=1e-9)


def test_quality_tails_by_plain_loops(spark):
    rng = np.random.default_rng(1)
    model = quality.Model(rng.normal(size=quality.BUCKETS).astype(np.float32), np.array([-0.5, 0.5]))
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    got = {r.i: r for r in quality.tails(df, model).collect()}
    for i, text in enumerate(TEXTS):
        raw, grams = text.encode(), []
        for n in (1, 2, 3):
            for at in range(len(raw) - n + 1):
                h = n
                for b in raw[at : at + n]:
                    h = (h * 0xD6E8FEB86659FD93 + int(bytekit.BYTE_VALUE[b])) & MASK
                grams.append((mix(h) >> 20) % quality.BUCKETS)
        words = re.findall(rb"[^\x20\x09-\x0d]+", raw)
        size, n_words = max(len(raw), 1), max(len(words), 1)
        kinds = [rb"[A-Z]", rb"[a-z]", rb"[0-9]", rb"[\x80-\xff]", rb"[!-/:-@\[-`{-~]"]
        counts = [min(20 * len(re.findall(k, raw)) // size, 20) for k in kinds]
        counts += [min(len(raw) // n_words, 20), 20 * len(set(words)) // n_words, int(math.log2(len(words) + 1))]
        extra = [mix(1000 * (k + 1) + c) % quality.BUCKETS for k, c in enumerate(counts)]
        z = quality.GRAM_WEIGHT * sum(float(model.weights[b]) for b in grams) / max(len(grams), 1) + sum(float(model.weights[b]) for b in extra)
        tail = [1 / (1 + math.exp(t - z)) for t in (-0.5, 0.5)]
        assert list(got[i].tail) == pytest.approx(tail, rel=1e-4) and got[i].expected_grade == pytest.approx(sum(tail), rel=1e-4)


def test_quality_edges(spark):
    """Nulls, empty, very long and repeated texts, clashing names, empty tables, and no ratings at all."""
    docs = [(1, None, 3.0, 1), (2, "", 3.0, 1), (None, "abc", 3.0, 1), (4, "word " * 50_000, 3.0, 1), (5, "same", 3.0, 1), (5, "same", 3.0, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, tail double, buckets int")
    none = spark.createDataFrame([(1, None), (None, 1), (9, 7)], "doc_id long, grade int")
    rows = grade_quality(df, none).collect()
    assert len(rows) == 6 and all(0 <= r.tail <= r.expected_grade <= 2 for r in rows)
    assert len({r.tail for r in rows if r.doc_id == 5}) == 1
    assert grade_quality(df.limit(0), none).count() == 0 == grade_quality(df.limit(0), none.limit(0)).count()
    one = spark.createDataFrame([(4, 1), (5, 1)], "doc_id long, grade int")
    assert grade_quality(df, one).count() == 6


def test_long_texts_teach(spark, monkeypatch):
    """Labelled texts of any length are in the sample; what is drawn of one is bounded, and the same in every run."""
    monkeypatch.setattr(tox, "UPDATES", 60)
    rng = random.Random(3)
    word = lambda k: "".join(rng.choice("abcdefghijklmnop") for _ in range(k))
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    docs = [(i, " ".join(word(6) for _ in range(3000)) + (" vile awful" * 600 if i % 2 else " kind nice" * 600)) for i in ids[:40]]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id long, toxic int")
    model = tox.train(df, labels)
    bad, good = (r.score for r in tox.score(spark.createDataFrame([(0, "vile awful vile"), (1, "kind nice kind")], "i int, text string"), model).orderBy("i").collect())
    assert bad > good
    doc, bucket = np.repeat(np.arange(3), [50, 5, 0]), np.concatenate((np.arange(50), np.arange(5)))
    data, off = np.frombuffer(b"onetwo", np.uint8), np.array([0, 3, 6, 6])
    kept = tox.drawn(doc, bucket, 20, data, off)
    assert kept.sum() == 25 and kept[50:].all()
    # The same of a text wherever it stands.
    assert (tox.drawn(doc[:50], bucket[:50], 20, data[:3], off[:2]) == kept[:50]).all()
