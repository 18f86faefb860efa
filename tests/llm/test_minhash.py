import random
import re

from tabloom.llm import queries
from tabloom.llm.minhash import drop_near_duplicates, near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = WORD.findall((text or "").translate(UPPER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(docs, n=4, percent=80):
    sets = {d: shingles(t, n) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for d, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(d)
    pairs = {(a, b) for ds in where.values() for i, a in enumerate(ds) for b in ds[i + 1 :]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return sorted((d, len(s), root(d), root(d) == d) for d, s in sets.items())


def test_query_against_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op9_minhash(spark, sf_dir).collect())) == brute(docs)


def test_chains_and_groups(spark, monkeypatch):
    """Near copies of a base, chains of edits that drift from it, and documents that share half."""
    rng = random.Random(5)
    fresh = lambda k: [f"x{rng.randrange(10**6)}" for _ in range(k)]
    docs, base = [], fresh(120)
    for k in range(60):
        words = list(base)
        words[rng.randrange(120)] = "edit"
        docs.append((500 - k, " ".join(words)))
    drift = fresh(100)
    for k in range(20):
        drift = list(drift)
        drift[(k * 5) % 100] = f"d{k}"
        docs.append((k + 1, " ".join(drift)))
    half = fresh(100)
    docs += [(1000 + k, " ".join(half + fresh(60))) for k in range(100)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs)
    assert sorted(map(tuple, near_duplicates(df, n=4).collect())) == want
    monkeypatch.setattr("tabloom.llm.minhash.BLOCK", 7)  # groups are compared in several blocks
    assert sorted(map(tuple, near_duplicates(df, n=4).collect())) == want


def test_edges(spark):
    docs = [(1, None, 0), (2, "", 1), (3, "one two", 2), (4, "ONE  two", 3), (5, " ", 4), (None, "one two", 5), (None, "odd", 6), (7, "a b c d " * 3000, 7), (9, "a b c d " * 3001, 8), (7, "a b c d " * 3000, 9)]
    df = spark.createDataFrame(docs, "doc_id long, text string, kept int")
    got = near_duplicates(df, n=4).collect()
    named = {(r.doc_id, r.component_id, r.kept) for r in got if r.doc_id is not None}
    assert named == {(1, 1, True), (2, 2, True), (3, 3, True), (4, 3, False), (5, 5, True), (7, 7, True), (9, 7, False)}
    assert sorted((r.component_id or 0, r.kept) for r in got if r.doc_id is None) == [(0, True), (3, True)]
    assert near_duplicates(df.limit(0)).count() == 0
    left = drop_near_duplicates(df)
    assert left.columns == df.columns and sorted(r.kept for r in left.collect()) == [0, 1, 2, 4, 5, 6, 7, 9]


def test_query_against_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.sql(queries.ORACLES["op9_minhash"])
    assert want.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, queries.op9_minhash(spark, sf_dir).collect())) == sorted(want.fetchall())


def test_signature_distance(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from tabloom.llm.minhash import CHUNK, index_keys, symbols_apart

    rng = np.random.default_rng(1)
    a = rng.integers(0, 3, (40, 32), dtype=np.uint16) * np.uint16(40000)
    b = rng.integers(0, 3, (40, 32), dtype=np.uint16) * np.uint16(40000)
    rows = [(i, *map(int, a[i].view(np.int64)), *map(int, b[i].view(np.int64))) for i in range(40)]
    df = spark.createDataFrame(rows, ", ".join(["id long", *(f"a{c} long" for c in CHUNK), *(f"b{c} long" for c in CHUNK)]))
    got = {r.id: r.d for r in df.select("id", symbols_apart("a", "b").alias("d")).collect()}
    assert got == {i: int((a[i] != b[i]).sum()) for i in range(40)}
    # Two signatures share a key exactly if some chunk of four symbols differs in one at most (in the same place).
    keys = index_keys(df.select("id", *(F.col(f"a{c}").alias(c) for c in CHUNK))).groupBy("id").agg(F.collect_set("key").alias("k")).collect()
    have = {r.id: set(r.k) for r in keys}
    for i in range(40):
        for j in range(i):
            wrong = (a[i] != a[j]).reshape(8, 4).sum(axis=1)
            assert bool(have[i] & have[j]) == bool((wrong <= 1).any())
            assert bool((wrong <= 1).any()) or (a[i] != a[j]).sum() > 15


def test_hot_pivots_and_long_texts(spark, monkeypatch):
    """Groups of thousands under one pivot are dealt to several tasks; blocks are cut by shingles too."""
    monkeypatch.setattr("tabloom.llm.common.SPREAD", 4)
    monkeypatch.setattr("tabloom.llm.common.HOT_PART", 20)
    monkeypatch.setattr("tabloom.llm.minhash.BLOCK_SHINGLES", 2_000)
    rng = random.Random(8)
    fresh = lambda k: [f"x{rng.randrange(10**6)}" for _ in range(k)]
    base, docs = fresh(150), []
    for k in range(150):
        words = list(base)
        for _ in range(k % 6):
            words[rng.randrange(150)] = f"e{k}"
        docs.append((900 - k, " ".join(words)))
    docs += [(1000 + k, " ".join(fresh(50) + base[:100])) for k in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, near_duplicates(df, n=4).collect())) == brute(docs)
