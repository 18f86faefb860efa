"""op12 against its SQL and against plain Python."""

import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tabloom.llm.phrases import _scored, mine_phrases
from tabloom.llm.queries import ORACLES, op12_phrases

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, most, least, covered, top):
    count, total = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, most + 1):
                count.update((lang, tuple(words[i : i + n])) for i in range(len(words) - n + 1))
    candidates = {k: a for k, a in count.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, words), a in candidates.items():
        within = any(
            g == lang and len(longer) > len(words) and 100 * f >= covered * a and any(longer[i : i + len(words)] == words for i in range(len(longer)))
            for (g, longer), f in candidates.items()
        )
        if within:
            continue
        cuts = []
        for k in range(1, len(words)):
            l, r = count[lang, words[:k]], count[lang, words[k:]]
            cuts.append((1_000_000 * a * a // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), l, r))
    rows = []
    for lang, found in out.items():
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            rows.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return sorted(rows)


def rows(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


DOCS = [
    *[("New York city is big. New York is far; the new\tyork  times", "en")] * 6,
    *[("in the New  York city. the the the the\x0bthe the", "en")] * 5,
    *[("a b a b a b a b", None)] * 3,
    *[("a b a b a b a b, é É ñ \x00 x y", "und")] * 4,
    (None, "en"), ("", "de"), (" \t ", None), ("...!?", "fr"), ("z " * 30_000, "long"), ("x\xa0y x\xa0y " * 12, "en"),
]


@pytest.mark.parametrize(("most", "least", "covered", "top"), [(3, 10, 50, 2_000), (2, 3, 50, 3), (5, 2, 90, 2_000)])
def test_against_plain_python(spark, most, least, covered, top):
    docs = spark.createDataFrame(DOCS, "text string, lang string").withColumns({"phrase": F.lit("own"), "batch": F.lit(None).cast("int"), "piece": F.lit(7)})
    want = brute([d for d in DOCS if d[1] != "long"], most, least, covered, top)
    got = mine_phrases(docs, most, least, covered, top)
    assert rows(got.where("lang <> 'long'")) == want
    # One word 30,000 times in one piece.
    assert rows(got.where("lang = 'long'")) == [("long", 1, " ".join(["z"] * most), 30_001 - most, *_cut(most), 30_000, _score(most))]


def _cut(most):
    scores = [(1_000_000 * (30_001 - most) ** 2 // ((30_001 - k) * (30_001 - most + k)), k) for k in range(1, most)]
    k = min(scores)[1]
    return 30_001 - k, 30_001 - most + k


def _score(most):
    return min(1_000_000 * (30_001 - most) ** 2 // ((30_001 - k) * (30_001 - most + k)) for k in range(1, most))


def test_whatever_the_partitions(spark):
    docs = spark.createDataFrame(DOCS, "text string, lang string")
    want = rows(mine_phrases(docs.coalesce(1)))
    assert rows(mine_phrases(docs.repartition(7))) == want


def test_empty_table(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert rows(mine_phrases(empty)) == []


def test_products_past_64_bits_are_exact(spark):
    big = 9_007_199_254_740_993
    counts = spark.createDataFrame([("g", 1, "a", big + 2), ("g", 1, "b", big + 4), ("g", 2, "a b", big)], "lang string, n int, phrase string, f long")
    row = _scored(counts, 3).first()
    assert (row.l, row.r, row.score) == (big + 2, big + 4, 1_000_000 * big * big // ((big + 2) * (big + 4)))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_its_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
    want = con.sql(ORACLES["op12_phrases"]).fetchall()
    assert rows(op12_phrases(spark, f"/root/testdata/{sf}")) == sorted(want)
