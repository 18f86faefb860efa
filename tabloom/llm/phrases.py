"""Phrases whose words stand together more often than their parts would by chance.

Texts are split at punctuation into pieces; equal pieces become one row with a multiplicity, so what many documents repeat is
counted once. Pieces are kept in batches, one a partition. A batch's distinct n-grams with their weights go to hash buckets,
where duckdb adds them up, on disk where they don't fit in memory. An n-gram row is also the batch's request to learn whether
the n-gram is frequent: the answers come back to the batch, which then counts only longer n-grams whose two parts, one
word shorter, are frequent. Others can't be. Counts of the parts of candidates are looked up by requests shuffled to them.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.common import discard, hot_keys, join_hot, partitions, written
from tabloom.llm.counting import run_sql, spill_folder

#: Distinct n-grams that a bucket holds, about.
BUCKET_ROWS = 1_000_000
#: Texts whose pieces a task counts at once.
TEXTS = 2_000
_ENDS = re.compile(rb"[.,;:!?\x0A-\x0D]")
_LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
WIDE = T.DecimalType(38, 0)


def pieces_of(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, piece, w): distinct pieces, of words with one space between, and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                some = batch.slice(at, TEXTS)
                found: Counter[tuple[str, bytes]] = Counter()
                for name, value in zip(some.column("lang").to_pylist(), some.column("text").to_pylist(), strict=True):
                    # split() cuts at the white space that words cannot have; line ends are gone by then.
                    joined = [b" ".join(piece.split()) for piece in _ENDS.split(value.encode().translate(_LOWER))]
                    found.update([(name, piece) for piece in joined if piece])
                names, texts = zip(*found, strict=True) if found else ((), ())
                for k in range(0, len(found), 50_000):
                    part = slice(k, k + 50_000)
                    columns = [pa.array(names[part], pa.string()), pa.array(texts[part], pa.binary()).cast(pa.string()), pa.array(list(found.values())[part], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "piece", "w"])

    rows = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text")).where("text IS NOT NULL")
    return rows.mapInArrow(run, "lang string, piece string, w long").groupBy("lang", "piece").agg(F.sum("w").alias("w"))


def _grams(n: int) -> str:
    """SQL for the n-grams, as a list of structs of n words, of the words ws; linear in the words, at any length."""
    return "list_zip(" + ", ".join(f"ws[{k}:]" for k in range(1, n + 1)) + ", true)" if n > 1 else "list_zip(ws, ws)"


def _joined(first: int, last: int) -> str:
    return " || ' ' || ".join(f"g[{k}]" for k in range(first, last + 1))


def _short_sql() -> str:
    """Words and pairs of words of each batch."""
    parts = [
        f"""SELECT batch, lang, {n} AS n, {_joined(1, n)} AS phrase, CAST(sum(w) AS BIGINT) AS w
            FROM (SELECT batch, lang, w, unnest({_grams(n)}) AS g FROM (SELECT *, string_split(piece, ' ') AS ws FROM rows)) GROUP BY ALL"""
        for n in (1, 2)
    ]
    return " UNION ALL ".join(parts)


def _long_sql(n: int) -> str:
    """n-grams of each batch whose parts of n - 1 words are both among the batch's frequent ones (rows with a phrase)."""
    return f"""
        WITH known AS (SELECT batch, lang, phrase FROM rows WHERE phrase IS NOT NULL),
        grams AS (SELECT batch, lang, w, unnest({_grams(n)}) AS g
                  FROM (SELECT *, string_split(piece, ' ') AS ws FROM rows WHERE piece IS NOT NULL)),
        parts AS (SELECT batch, lang, w, g, {_joined(1, n - 1)} AS a, {_joined(2, n)} AS b FROM grams)
        SELECT batch, lang, {n} AS n, {_joined(1, n)} AS phrase, CAST(sum(w) AS BIGINT) AS w FROM parts
        WHERE (batch, lang, a) IN (SELECT (batch, lang, phrase) FROM known) AND (batch, lang, b) IN (SELECT (batch, lang, phrase) FROM known)
        GROUP BY ALL"""


GRAM = "batch int, lang string, n int, phrase string, w long"
COUNTED = "batch int, lang string, n int, phrase string, f long, first boolean"


def _count(grams: DataFrame, buckets: int, least: int, spill: str) -> DataFrame:
    """Frequent n-grams, a row for each batch that asked, one of them marked `first`."""
    sql = f"""
        WITH sums AS (SELECT lang, phrase, n, CAST(sum(w) AS BIGINT) AS f, min(batch) AS least FROM rows GROUP BY ALL HAVING sum(w) >= {least})
        SELECT r.batch, r.lang, r.n, r.phrase, s.f, r.batch = s.least AS first FROM rows r JOIN sums s USING (lang, phrase, n)
        WHERE r.n > 1 OR r.batch = s.least"""
    return written(run_sql(grams.repartition(buckets, "lang", "phrase"), sql, COUNTED, spill), "phrases")


def mine_phrases(docs: DataFrame, most_words: int = 3, least: int = 10, covered: int = 50, top: int = 2_000, text: str = "text", lang: str = "lang", spill: str | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each lang's `top` phrases of 2 to `most_words` words, best first.

    a, l, r are how often the phrase and the parts of its lowest-scoring cut occur, n all words of the lang; score is
    floor(1000000 a a / (l r)), exact. Phrases with a < least don't count, nor those whose words lie within a longer
    candidate with 100 f >= covered a. Ties: larger a, then the phrase by its bytes. A null lang is "und", a null or
    empty text has no words, a text may be one piece of any length, repeated rows count each, an empty table gives an empty
    result; other columns are not looked at, whatever their names. A batch's piece table and counts lie in the shared
    folder until the end. `spill` is a mounted folder for duckdb, by default the shared one."""
    if most_words < 2 or least < 1:
        raise ValueError("phrases have two words at least, and occur once at least")
    spark = docs.sparkSession
    spill = spill or spill_folder(spark)
    # A batch is a partition of the distinct pieces, fixed by being written.
    pieces = written(pieces_of(docs, text, lang).withColumn("batch", F.spark_partition_id()), "pieces")
    words = F.length("piece") - F.length(F.replace("piece", F.lit(" "))) + 1
    totals = written(pieces.groupBy("lang").agg(F.sum(F.col("w") * words).alias("n"), F.sum(words).alias("distinct")), "words")
    buckets = max(partitions(spark), (totals.agg(F.sum("distinct")).first()[0] or 0) // BUCKET_ROWS)

    counted = [_count(run_sql(pieces, _short_sql(), GRAM, spill), buckets, least, spill)]
    for n in range(3, most_words + 1):
        answers = counted[-1].where(F.col("n") == n - 1).select("batch", "lang", "phrase")
        both = pieces.unionByName(answers, allowMissingColumns=True).repartition("batch")
        counted.append(_count(run_sql(both, _long_sql(n), GRAM, spill), buckets, least, spill))
    counts = counted[0]
    for more in counted[1:]:
        counts = counts.union(more)
    counts = counts.where("first").select("lang", "n", "phrase", "f")
    best = written(_rank(_uncovered(_scored(counts, most_words), counts, covered), top).join(F.broadcast(totals.select("lang", "n")), "lang"), "phrases")
    discard(pieces, *counted)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _scored(counts: DataFrame, most_words: int) -> DataFrame:
    """Candidates with the counts of the parts of their lowest-scoring cut."""
    words = F.split("phrase", " ")
    candidates = counts.where("n > 1").select("lang", "phrase", F.col("f").alias("a"), F.col("n").alias("size"))
    # Two requests a cut, one for each part. They are shuffled to the parts' counts, and the answers to the candidates.
    cuts = F.explode(F.expr("sequence(1, size - 1)"))
    asked = candidates.select("*", cuts.alias("k")).select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("is_left"))
    part = F.when(F.col("is_left"), F.array_join(F.slice(words, F.lit(1), F.col("k")), " ")).otherwise(F.array_join(F.slice(words, F.col("k") + 1, F.col("size")), " "))
    asked = asked.withColumn("part", part)
    asks = asked.groupBy("part").agg(F.count("*").alias("c"))
    hot = hot_keys(asks, "part", "c", asks.agg(F.sum("c")).first()[0] or 0)
    answered = join_hot(asked, counts.select(F.col("phrase").alias("part"), "lang", F.col("f").alias("part_f")), ["part", "lang"], hot)
    sides = [F.max(F.when((F.col("k") == k) & (F.col("is_left") == left), F.col("part_f"))).alias(f"{'l' if left else 'r'}{k}") for k in range(1, most_words) for left in (True, False)]
    wide = answered.groupBy("lang", "phrase", "a", "size").agg(*sides)
    # Counts are below 10^16, so the numerator has 38 digits at most.
    a = F.col("a").cast(T.DecimalType(16, 0))
    top = (a * a).cast(WIDE) * F.lit(1_000_000).cast(T.DecimalType(7, 0))

    def cut(k: int):
        l, r = F.col(f"l{k}"), F.col(f"r{k}")
        under = l.cast(T.DecimalType(16, 0)) * r.cast(T.DecimalType(16, 0))
        score = F.call_function("div", top.cast(WIDE), under.cast(WIDE)).cast("long")
        return F.when(l.isNotNull() & r.isNotNull(), F.struct(score.alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r")))

    lowest = F.array_min(F.array_compact(F.array(*(cut(k) for k in range(1, most_words)))))
    return wide.withColumn("cut", lowest).select("lang", "phrase", "a", "size", "cut.l", "cut.r", "cut.score")


def _uncovered(scored: DataFrame, counts: DataFrame, covered: int) -> DataFrame:
    """Candidates without those that lie within a longer one that is frequent enough."""
    spans = F.expr("flatten(transform(sequence(2, n - 1), m -> transform(sequence(1, n - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))")
    within = counts.where("n > 2").select("lang", F.explode(spans).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    joined = scored.join(within, ["lang", "phrase"], "left")
    return joined.where(F.col("longer").isNull() | (F.col("longer").cast(WIDE) * 100 < F.col("a").cast(WIDE) * covered)).drop("longer")


def _rank(rows: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
