"""Words that collide under a polynomial modulo 2^64, and results that must not depend on partitions."""

import numpy as np
import pytest

from tabloom.llm import quality, toxicity
from tabloom.llm.bytekit import NOT_SPACE, prefix_hash, span_hash, word_hash, words
from tabloom.llm.decontaminate import matches
from tabloom.llm.minhash import near_duplicates
from tabloom.llm.quantise import search


def thue_morse(n):
    first = "a"
    while len(first) < n:
        first += first.translate(str.maketrans("ab", "ba"))
    return first, first.translate(str.maketrans("ab", "ba"))


def test_word_hashes_are_of_the_bytes():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 100, n, dtype=np.uint8)) for n in [*rng.integers(1, 12, 4_000), *rng.integers(1, 90, 2_000), 63, 64, 65, 500]]
    data = np.frombuffer(b" ".join(texts) + b" " + b" ".join(texts), np.uint8)
    starts, ends, _ = words(data, np.array([0, len(data)]), NOT_SPACE)
    for second in (False, True):
        hashes = word_hash(data, starts, ends, second)
        assert (hashes[: len(texts)] == hashes[len(texts) :]).all()
        assert len(set(hashes.tolist())) == len(set(texts))
    assert not len(word_hash(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)))


@pytest.mark.parametrize("n", [1_024, 2_048])
def test_thue_morse_words(spark, n):
    one, two = thue_morse(n)
    data = np.frombuffer(f"{one} {two}".encode(), np.uint8)
    starts, ends, _ = words(data, np.array([0, len(data)]), NOT_SPACE)
    sums = span_hash(prefix_hash(data), starts, ends)
    assert sums[0] == sums[1]  # the pair does collide there
    docs = spark.createDataFrame([(1, " ".join([one] * 12)), (2, " ".join([two] * 12)), (3, " ".join([one] * 12))], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, n=4, percent=80).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    benchmark = spark.createDataFrame([("x", " ".join([one] * 10))], "item_id string, text string")
    found = {r.doc_id: list(r["items"]) for r in matches(docs, benchmark).collect()}
    assert found == {1: ["x"], 2: [], 3: ["x"]}


@pytest.mark.parametrize("parts", [1, 5])
def test_many_rows_of_one_id_take_one_place(spark, parts):
    rng = np.random.default_rng(3)
    far = [(k, [float(x) for x in rng.normal(5, 1, 8)]) for k in range(1, 17)]
    near = [(500, [0.1 + float(x) for x in rng.normal(0, 0.01, 8)]) for _ in range(500)]
    table = spark.createDataFrame([(0, [0.1] * 8), *far, *near], "vec_id long, embedding array<double>").repartition(parts)
    got = sorted((r["rank"], r.vec_id, r.score) for r in search(table, table.where("vec_id = 0"), k=10, rerank=20).collect())
    distance = {k: float(np.sqrt(((np.array(v) - 0.1) ** 2).sum())) for k, v in far}
    best = min(float(np.sqrt(((np.array(v) - 0.1) ** 2).sum())) for _, v in near)
    want = [(500, best), *sorted(distance.items(), key=lambda x: x[1])[:9]]
    assert [(r, i) for r, i, _ in got] == [(k + 1, i) for k, (i, _) in enumerate(want)]
    assert [s for *_, s in got] == pytest.approx([s for _, s in want])


def test_models_don_t_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_GRAMS", 50)
    monkeypatch.setattr(quality, "SAMPLE_GRAMS", 50)
    monkeypatch.setattr(toxicity, "UPDATES", 40)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    ratings = labels.selectExpr("doc_id", "quality + quality * (1 - toxic) AS grade")
    toxic, graded = [], []
    for n in (1, 3, 16):
        some = docs.repartition(n)
        toxic.append(sorted((r.doc_id, r.score) for r in toxicity.toxicity(some, labels).collect()))
        graded.append(sorted(map(tuple, quality.grade_quality(some, ratings, least=1).collect())))
    assert toxic[0] == toxic[1] == toxic[2]
    assert graded[0] == graded[1] == graded[2]
