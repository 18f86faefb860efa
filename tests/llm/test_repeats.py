import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabloom.llm import queries
from tabloom.llm.repeats import remove_repeats
from tabloom.llm.suffix import common_prefixes, packed_bytes, suffix_array


def brute(docs, length):
    raw = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(hash(x[i : i + length]) for _, x in raw for i in range(len(x) - length + 1))
    for d, x in raw:
        gone = [False] * (len(x) + 1)
        for i in range(len(x) - length + 1):
            if seen[hash(x[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(x)))
        kept = bytes(b for b, g in zip(x, gone, strict=False) if not g)
        yield d, len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()


def rows(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


def test_query_against_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert rows(queries.op6_suffix_dedup(spark, sf_dir)) == sorted(brute(docs, 400), key=str)


def test_larger_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    assert rows(remove_repeats(docs, with_kept=False)) == sorted(brute([tuple(r) for r in docs.collect()], 400), key=str)


def test_hot_keys(spark, monkeypatch):
    """A third exact copies, a third near copies, one line everywhere: keys with many rows are dealt to several tasks."""
    monkeypatch.setattr("tabloom.llm.common.SPREAD", 4)
    monkeypatch.setattr("tabloom.llm.common.HOT_PART", 50)
    rng = random.Random(5)
    fresh = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    copy, near, line = fresh(300), fresh(280), "the same old line. "
    docs = [(i, copy) for i in range(150)] + [(200 + i, near[:140] + fresh(3) + near[140:]) for i in range(150)]
    docs += [(400 + i, fresh(60) + line * (i % 9) + fresh(40)) for i in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    assert rows(remove_repeats(df, length=40, k=12)) == sorted(brute(docs, 40), key=str)


@pytest.mark.parametrize("most", [2000, 3])  # with 3, minimisers are divided and classes merged across shards
def test_planted(spark, monkeypatch, most):
    monkeypatch.setattr("tabloom.llm.repeats.MOST_CONTEXTS", most)
    monkeypatch.setattr("tabloom.llm.repeats.SHARD_BYTES", 4000)
    monkeypatch.setattr("tabloom.llm.repeats.STRETCH", 50)  # texts have several stretches of lone contexts
    rng = random.Random(3)
    fresh = lambda k: "".join(rng.choice("abcdé ") for _ in range(k))
    passage, other = fresh(130), fresh(300)
    docs = [(i, fresh(rng.randrange(200)) + passage + fresh(rng.randrange(200))) for i in range(40)]
    docs += [(50 + i, fresh(30) + other[i * 20 : i * 20 + 90] + fresh(30)) for i in range(10)]
    docs += [(70, "ab" * 400), (71, None), (72, ""), (73, passage), (74, passage), (74, passage), (None, passage), (75, "x" * 39), (76, "y" * 40), (77, "z" * 41)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(remove_repeats(df, length=40, k=12)) == sorted(brute(docs, 40), key=str)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, spans int")
    assert remove_repeats(df).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=300), st.sampled_from([2, 256]), st.integers(1, 40))
def test_suffix_array(raw, letters, most):
    data = np.frombuffer(bytes(1 + b % (letters - 1 or 1) if letters == 256 else 1 + b % 2 for b in raw), np.uint8)
    text = data.tobytes()
    packed = packed_bytes(data)
    order = suffix_array(packed, 8, len(data) + 1)
    want = sorted(range(len(text)), key=lambda i: text[i:])
    assert order.tolist() == want
    got = common_prefixes(packed, order, most, lanes=7)
    for r in range(1, len(text)):
        a, b = text[want[r - 1] :], text[want[r] :]
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert got[r] == min(n, most)
