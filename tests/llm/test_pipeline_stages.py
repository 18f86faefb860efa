"""Each stage of the corpus pipeline against a brute-force version of it, on what the stage before kept."""

import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_chunks import brute as chunked
from test_minhash import brute as near
from test_mixing import check

from tabloom.llm import toxicity as tox

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_toxicity_stage(spark, sf_dir, documents):
    kept = corpus_pipeline.toxicity(spark, documents, sf_dir)
    model = tox.train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = {r.doc_id: r.score for r in tox.score(documents, model).collect()}
    assert kept.columns == documents.columns and sorted(d for d, _ in texts(kept)) == sorted(d for d, s in scores.items() if s < 0.5)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    gone = set(scores) - {d for d, _ in texts(kept)}
    assert 0 < len(gone) < 0.4 * len(scores) and sum(labels[d] for d in gone if d in labels) >= 0.8 * sum(labels.values())


def test_near_duplicates_stage(spark, sf_dir, documents):
    kept = corpus_pipeline.near_duplicates(spark, documents, sf_dir)
    assert kept.columns == documents.columns
    assert sorted(d for d, _ in texts(kept)) == sorted(d for d, _, _, k in near(texts(documents), n=5) if k) and kept.count() < documents.count()


def test_substrings_stage(spark, sf_dir, documents):
    kept = dict(texts(corpus_pipeline.substrings(spark, documents, sf_dir)))
    before = dict(texts(documents))
    want = {d: t for d, t in chunked(texts(documents)) if t == before[d] or t.strip(" ")}
    assert kept == want and any(kept[d] != before[d] for d in kept)


def test_decontamination_stage(spark, sf_dir, documents):
    kept = {d for d, _ in texts(corpus_pipeline.decontamination(spark, documents, sf_dir))}
    cut = lambda t: WORD.findall((t or "").translate(UPPER))
    windows = {tuple(w[i : i + 10]) for w in (cut(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()) if w for i in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    hit = lambda w: any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))
    assert kept == {d for d, t in texts(documents) if not hit(cut(t))} and len(kept) < documents.count()


def test_mixing_stage(spark, sf_dir, documents):
    out = corpus_pipeline.mixing(spark, documents, sf_dir)
    assert set(documents.columns) < set(out.columns)
    taken = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    mixed = {(r.doc_id): r for r in out.select("doc_id", "size", "source_size", "target").distinct().collect()}
    rows = [type("Row", (), {"doc_id": d, "size": r.size, "source_size": r.source_size, "target": r.target, "taken": taken[d] * r.size}) for d, r in mixed.items()]
    docs = [(r.doc_id, r.text, r.source) for r in documents.collect()]
    left = [x for x in docs if x[0] not in taken]
    sizes = {s: (r.source_size, r.target) for s, r in ((next(x[2] for x in docs if x[0] == d), r) for d, r in mixed.items())}
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    rows += [type("Row", (), {"doc_id": d, "size": words(t), "source_size": sizes[s][0], "target": sizes[s][1], "taken": 0}) for d, t, s in left]
    check(rows, docs)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_edges(spark, sf_dir, name):
    """Nulls in any column, empty and long texts, repeated rows, clashing names, and an empty table."""
    rows = [(1, None, "a", None, 1, 5), (2, "", None, "s", 0, 5), (None, "no id here", "a", "s", None, 5), (4, "word and more " * 9_000, "a", "s", 9, 5), (5, "the same row", "a", "s", 9, 5), (5, "the same row", "a", "s", 9, 5), (6, " ", "a", "t", 1, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long" if name == "mixing" else "doc_id long, text string, lang string, source string, n_chars long, kept long")
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, df, sf_dir)
    assert out.columns == df.columns or name == "mixing"
    found = out.collect()
    if name != "mixing":
        assert {r.doc_id for r in found} == {1, 2, None, 4, 5, 6} and sum(r.doc_id == 5 for r in found) in (1, 2)
    assert stage(spark, df.limit(0), sf_dir).count() == 0


def test_run(spark, sf_dir, documents):
    out = corpus_pipeline.run(spark, sf_dir)
    assert set(documents.columns) <= set(out.columns)
    assert out.count() > 0.3 * documents.count()
    assert out.join(documents, "doc_id", "left_anti").isEmpty()
