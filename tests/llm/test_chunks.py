import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tabloom.llm.bytekit import text_buffer
from tabloom.llm.chunks import MOST, cut_places, dedup_substrings, without_repeats


def chunks(text):
    data, off = text_buffer(pa.array([text], pa.large_string()))
    at = cut_places(data, off).tolist()
    return [data[a:b].tobytes() for a, b in zip(at, at[1:] + [len(data)], strict=False)]


def brute(docs, min_run=100):
    owner = {}
    for d, t in docs:
        for c in set(chunks(t or "")):
            owner[c] = min(owner.get(c, d), d)
    for d, t in docs:
        seen, runs, out = set(), [], b""
        for c in chunks(t or ""):
            repeat = owner[c] != d or c in seen
            seen.add(c)
            if runs and runs[-1][0] == repeat:
                runs[-1][1] += c
            else:
                runs.append([repeat, c])
        for repeat, c in runs:
            out += b"" if repeat and len(c) >= min_run else c
        yield d, out.decode()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=400), max_size=6))
def test_chunks_make_up_the_texts(texts):
    data, off = text_buffer(pa.array([*texts, "é" * 700, "a" * 900], pa.large_string()))
    at = cut_places(data, off)
    assert (np.diff(at) > 0).all() and set(off[:-1][np.diff(off) > 0]) <= set(at.tolist())
    assert not len(at) or np.diff(np.append(at, len(data))).max() <= MOST + 3
    assert all((data[p] & 0xC0) != 0x80 for p in at)


def test_shifts_and_brute_force(spark):
    rng = random.Random(2)
    fresh = lambda k: " ".join("".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(2, 9))) for _ in range(k))
    passage = fresh(60)
    docs = [(i, f"{fresh(rng.randrange(5, 90))} {passage} {fresh(20)}") for i in range(30)] + [(50, "é" * 900), (51, "é" * 900), (60, fresh(300)), (61, ""), (62, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in dedup_substrings(df).collect()}
    assert {d: r.kept for d, r in got.items()} == dict(brute(docs))
    assert got[0].n_removed == 0 and all(got[i].n_removed > 100 for i in range(1, 30)) and got[60].n_removed == 0


def test_query_against_brute_force(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.collect()]
    assert {r.doc_id: r.kept for r in dedup_substrings(df).collect()} == dict(brute(docs))


def test_edges(spark):
    rows = [(1, "x" * 300 + "unlike", "k"), (None, "y z " * 100, "k"), (None, "y z " * 100, "k"), (3, "y z " * 100, "k"), (3, " ", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    out = without_repeats(df)
    assert out.columns == df.columns
    left = defaultdict(int)
    for r in out.collect():
        left[r.doc_id] += 1
    assert left[1] == 1 and left[3] == 2 and left[None] == 0
    assert dedup_substrings(df.limit(0)).count() == 0
