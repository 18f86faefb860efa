import hashlib
import random
import re
from collections import defaultdict

from tabloom.llm import queries
from tabloom.llm.decontaminate import decontaminate, matches

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(docs, items):
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        if i is None or not w:
            continue
        for k in range(max(1, len(w) - 9)):
            windows[tuple(w[k : k + 10])].add(str(i))
    sizes = {len(w) for w in windows}
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[x]
        names = ",".join(sorted(found))
        yield d, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)


def rows(df):
    return sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect())


def test_query_against_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert rows(queries.op3_decontamination(spark, sf_dir)) == sorted(brute(docs, items))


def small(spark):
    long = " ".join(f"w{i}" for i in range(30))
    docs = [
        (1, f"Intro {long} end", "a"),
        (2, "nothing here", "b"),
        (3, None, None),
        (4, "", "d"),
        (5, "Short ITEM, short item", "e"),
        (None, long, "f"),
        (6, " ".join(f"w{i}" for i in range(9)), "g"),
        (7, "w " * 5000 + long, "h"),
    ]
    items = [(1, long), (1, "short item"), (2, None), (None, long), (3, ""), (10, "w25 w26 w27 w28 w29")]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, items string"),
        spark.createDataFrame(items, "item_id long, text string"),
        docs,
        items,
    )


def test_edges_and_clashing_names(spark, tmp_path):
    docs, bench, d, i = small(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    key = lambda r: (r[0] is None, r[0] or 0)
    got = [tuple(r)[:6] for r in queries.op3_decontamination(spark, str(tmp_path)).collect()]
    assert sorted(got, key=key) == sorted(brute([x[:2] for x in d], i), key=key)
    kept = decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 6]
    found = {r.doc_id: r for r in matches(docs, bench).collect()}
    assert (found[1].longest, found[1].longest_at, found[1].longest_item) == (30, 1, "1")
    assert found[2].longest == 0


def test_blocks_give_the_same(spark, monkeypatch):
    docs, bench, *_ = small(spark)
    one = sorted(map(str, matches(docs, bench).drop("longest_at").collect()))
    monkeypatch.setattr("tabloom.llm.decontaminate.BLOCK_BYTES", 40)
    assert sorted(map(str, matches(docs, bench).drop("longest_at").collect())) == one


def test_empty_tables(spark):
    docs, bench, *_ = small(spark)
    assert matches(docs.limit(0), bench).count() == 0
    assert {len(r["items"]) for r in matches(docs, bench.limit(0)).collect()} == {0}


def longest_brute(text, items):
    w, best = words(text), (0, None, set())
    for k in range(len(w)):
        for i, t in items:
            v = words(t)
            for j in range(len(v) if i is not None else 0):
                n = 0
                while k + n < len(w) and j + n < len(v) and w[k + n] == v[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, k, {str(i)})
                elif n and (n, k) == best[:2]:
                    best[2].add(str(i))
    return best


def test_longest_of_every_document(spark, monkeypatch):
    long = " ".join(f"w{i}" for i in range(50))
    copies = [f"a {long} b", f"a {long} b", f"x y {long}", " ".join(f"w{i}" for i in range(12)) + " z", "w3 w4 q w48 w49 q w0", "z " + " ".join(f"w{i}" for i in range(20, 35)), "r r r r r", "r r", "", None, "none", "w49"]
    items = [(1, long), (2, "w20 w21 w22 w23 w99 r r r"), (3, "w3 w4 q w48"), (None, "none"), (4, None), (5, "r r r r r r r")]
    rng = random.Random(1)
    copies += [" ".join(rng.choices("abcr", k=rng.randint(1, 40))) for _ in range(60)]
    items += [(10 + k, " ".join(rng.choices("abcr", k=rng.randint(1, 25)))) for k in range(12)]
    docs = spark.createDataFrame(list(enumerate(copies)), "doc_id int, text string").coalesce(1)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 100):
        monkeypatch.setattr("tabloom.llm.decontaminate.BLOCK_BYTES", block)
        got = matches(docs, bench).collect()
        assert len(got) == len(copies)
        for r in got:
            n, at, names = longest_brute(copies[r.doc_id], items)
            assert (r.longest, r.longest_at) == (n, at), r
            assert r.longest_item in names if n else r.longest_item is None
