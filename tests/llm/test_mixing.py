import re
from collections import defaultdict

import pytest

from tabloom.llm import queries
from tabloom.llm.mixing import emit_copies, mix_sources

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shares(sizes, weights=(5.0, 2.0, 1.0), most=3.0):
    """Water filling, one source after the other: {source: target}."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, target = float(sum(sizes.values())), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def check(rows, docs):
    size = {d: len(WORD.findall(t or "")) for d, t, _ in docs}
    sizes = defaultdict(int)
    for d, _, s in docs:
        sizes[s] += size[d]
    want, source = shares(sizes), {d: s for d, _, s in docs}
    taken, longest = defaultdict(int), defaultdict(int)
    assert len(rows) == len(docs)
    for r in rows:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], sizes[s]) and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
        longest[s] = max(longest[s], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 3 * longest[s] + 1e-6


def test_query_meets_targets(spark, sf_dir):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = queries.op2_mixing(spark, sf_dir).collect()
    check(rows, docs)
    assert sum(r.taken for r in rows) > 0
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.op2_mixing(spark, sf_dir).collect()))


def test_caps_nulls_and_hot_sizes(spark, monkeypatch):
    monkeypatch.setattr("tabloom.llm.mixing.BUCKET_ROWS", 20)
    docs = [(i, "w " * (i % 7 + 1), "big") for i in range(600)] + [(1000 + i, "one two three", "hot") for i in range(300)]
    docs += [(2000, "tiny text", "a"), (2001, None, None), (2002, "", None), (2003, "null source here", None), (2004, None, "empty")]
    df = spark.createDataFrame([(*d, "x", 5) for d in docs], "doc_id long, text string, source string, target string, size int")
    mixed = mix_sources(df)
    check(mixed.select("doc_id", "size", "source_size", "target", "taken").collect(), docs)
    assert emit_copies(mixed).count() == mixed.selectExpr("sum(copies) c").first().c > 0


def test_rows_without_id_or_with_the_same(spark, monkeypatch):
    """Buckets that one id overfills are dealt by text; nothing is lost, and reruns agree."""
    monkeypatch.setattr("tabloom.llm.mixing.BUCKET_ROWS", 3)
    docs = [(None if i % 3 == 0 else 7, f"text {i}", "a") for i in range(200)] + [(i, "x " * 20_000, "b") for i in range(3)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, source string, key int")
    rows = [tuple(r) for r in mix_sources(df).collect()]
    assert len(rows) == len(docs) and sorted(map(str, rows)) == sorted(str(tuple(r)) for r in mix_sources(df.repartition(5)).collect())
    taken, target = sum(r[-1] for r in rows if r[2] == "a"), next(r[-3] for r in rows if r[2] == "a")
    assert abs(taken - target) <= 6 and all(r[-1] <= 3 * r[4] for r in rows)


def test_exact_three_copies(spark):
    """At a step of exactly 3 no document gets a fourth copy, however far the sum has run."""
    docs = [(i, 1 if i else 10**12, "abc"[0] if i else "z", 0) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, size long, source string, spread long")
    rows = mix_sources(df, weights=(5.0, 1.0), sized=True).collect()
    assert {r.copies for r in rows if r.source == "a"} == {3}


def test_empty(spark):
    assert mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
