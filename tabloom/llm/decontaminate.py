"""Benchmark decontamination by suffix arrays of the training text.

Each shard (a few megabytes of whole documents, where Spark reads them) gets a suffix array over its
words; every suffix of every benchmark item is binary-searched in it, which gives all places of every
window, and the longest verbatim match of every place of the shard. Documents are only read, so the operator
has no shuffle; a shard does not depend on others and is simply made again if its executor is lost.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.bytekit import ALNUM, LOWER, pieces, ranges, word_hash, words
from tabloom.llm.common import cut
from tabloom.llm.docmap import add_columns
from tabloom.llm.suffix import search, suffix_array

WINDOW = 10
#: Benchmark text sent to the tasks at once; a larger benchmark takes several passes over the documents.
BLOCK_BYTES = 16_000_000

FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_from", T.ArrayType(T.IntegerType())),
    T.StructField("hit_to", T.ArrayType(T.IntegerType())),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("longest", T.IntegerType()),
    T.StructField("longest_at", T.IntegerType()),
    T.StructField("longest_item", T.StringType()),
]


def tokens_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of each document with a 0 after it, the n + 1 offsets of documents in them, and
    the documents' numbers of words."""
    data = LOWER[data]
    starts, ends, at = words(data, off, ALNUM)
    hashes = word_hash(data, starts, ends) | np.uint64(1)  # never 0
    n = np.diff(at)
    first = at[:-1] + np.arange(len(n))
    tokens = np.zeros(len(hashes) + len(n), np.uint64)
    tokens[ranges(first, n)] = hashes
    return tokens, np.append(first, len(tokens)), n


class Tests:
    """The words of a block of benchmark items, as every task gets them."""

    def __init__(self, rows: list[tuple[str, str]], window: int):
        text = pa.array([t or "" for _, t in rows], pa.large_string())
        parts = [tokens_of(data, off) for _, _, data, off in pieces(text, 1 << 40)]
        self.tokens, self.at, n = parts[0] if parts else (np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int64))
        self.names = np.array([i for i, _ in rows], dtype=object)
        self.item = np.repeat(np.arange(len(n)), n)  # of each suffix
        self.start = ranges(self.at[:-1], n)
        self.left = np.repeat(self.at[:-1] + n, n) - self.start  # words from the suffix to its item's end
        size = np.repeat(n, n)
        self.window = np.where(size < window, size, window)
        self.windowed = (self.left >= window) | ((size < window) & (self.left == size))
        self.depth = int(n.max(initial=0))


def shard_matches(tests: Tests, tokens: np.ndarray) -> tuple[np.ndarray, ...]:
    """Places, lengths and items of all window occurrences; then, for every place of the shard, the
    length of its longest match with a test suffix (0 if none) and the first item that has it."""
    order = suffix_array(tokens, 1, tests.depth)
    n = len(tests.start)
    lo, hi = np.zeros(n, np.int64), np.full(n, len(order), np.int64)
    found_lo, found_hi = np.zeros(n, np.int64), np.zeros(n, np.int64)
    longest, whose = np.zeros(len(order), np.int32), np.zeros(len(order), np.int64)
    first_of = np.zeros(len(order) + 1, np.int64)
    alive = np.arange(n)
    first = tokens[order]
    depth = 0
    while len(alive):
        # Ranges of one depth are the same or disjoint. Suffixes that leave a range with the first of its
        # test suffixes match `depth` words; those that another one takes further are set again later.
        first_of[lo[alive[::-1]]] = alive[::-1]
        heads = alive[first_of[lo[alive]] == alive]
        old_lo, old_hi = lo[heads], hi[heads]
        done = alive[tests.left[alive] <= depth]
        hi[done] = lo[done]
        alive = alive[tests.left[alive] > depth]
        if depth == 0:
            wanted = tests.tokens[tests.start[alive]]
            lo[alive], hi[alive] = np.searchsorted(first, wanted, "left"), np.searchsorted(first, wanted, "right")
        else:
            lo[alive], hi[alive] = search(tokens, order, tests.tokens, depth, tests.start[alive], lo[alive], hi[alive])
            for begin, size in ((old_lo, lo[heads] - old_lo), (hi[heads], old_hi - hi[heads])):
                slots = ranges(begin, size)
                longest[slots], whose[slots] = depth, np.repeat(tests.item[heads], size)
        alive = alive[lo[alive] < hi[alive]]
        full = alive[tests.windowed[alive] & (tests.window[alive] == depth + 1)]
        found_lo[full], found_hi[full] = lo[full], hi[full]
        depth += 1
    counts = found_hi - found_lo
    places = order[ranges(found_lo, counts)]
    by_place = np.zeros(len(order), np.int32), np.zeros(len(order), np.int64)
    by_place[0][order], by_place[1][order] = longest, whose
    return places, np.repeat(tests.window, counts), np.repeat(tests.item, counts), *by_place


def _lists(values: np.ndarray, rows: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """List column of n rows from values whose rows are in order."""
    off = np.searchsorted(rows, np.arange(n + 1), "left").astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, kind))


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, drop: tuple[str, ...] = ()) -> DataFrame:
    """Documents with what they share with the benchmark: n_words; hit_from and hit_to, the disjoint
    stretches of words [from, to) inside occurring windows; items, the distinct ids, as sorted
    strings, of items with occurring windows; and the document's longest match with any item, the first
    of them: its words (0 if none), its first word and an item that has it.

    Words are the runs of ASCII letters and digits and of characters from U+0080 on, with A-Z lower-cased.
    A window is `window` consecutive words of an item, or a whole item of fewer. Null and empty
    texts have no words and no matches; items that are null, without words or without id match
    nothing; items with the same id are one. Repeated documents are judged one by one. Columns of
    docs with the new names are replaced.
    """
    benchmark = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    total = benchmark.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_BYTES))
    out = docs
    for k in range(blocks):
        # With several blocks what is found so far is kept, so that each job and its tasks hold one block only.
        out = cut(out) if k else out
        part = benchmark if blocks == 1 else benchmark.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        tests = Tests(sorted(map(tuple, part.collect())), window)  # one block of bounded size
        out = add_columns(out, _kernel(tests, follows=k > 0), FIELDS, text, drop if k == blocks - 1 else (), reads=tuple(f.name for f in FIELDS) if k else ())
    return out


def _kernel(tests: Tests, follows: bool):
    def kernel(data: np.ndarray, off: np.ndarray, rows: pa.RecordBatch) -> list[pa.Array]:
        tokens, at, n_words = tokens_of(data, off)
        n = len(n_words)
        places, sizes, items, longest, whose = shard_matches(tests, tokens)
        change = np.zeros(len(tokens) + 1, np.int64)
        np.add.at(change, places, 1)
        np.add.at(change, places + sizes, -1)
        if follows:  # stretches of an earlier block of the benchmark
            for name, sign in (("hit_from", 1), ("hit_to", -1)):
                old = rows.column(name)
                flat = old.flatten().to_numpy()
                np.add.at(change, flat + np.repeat(at[:-1], old.value_lengths().to_numpy()), sign)
        hit = np.cumsum(change[:-1]) > 0
        edge = np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        row = np.searchsorted(at, begin, "right") - 1
        doc = np.searchsorted(at, places, "right") - 1
        pairs = np.unique(doc * (len(tests.names) + 1) + items) if len(doc) else np.zeros(0, np.int64)
        named: list[list[str]] = [[] for _ in range(n)] if not follows else rows.column("items").to_pylist()
        for p in pairs.tolist():
            named[p // (len(tests.names) + 1)].append(tests.names[p % (len(tests.names) + 1)])
        best, best_at, best_item = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.full(n, None, object)
        if follows:
            best, best_at = (rows.column(c).fill_null(-1).to_numpy().astype(np.int64) for c in ("longest", "longest_at"))
            best_item = np.array(rows.column("longest_item").to_pylist(), object)
        if n:
            most = np.maximum.reduceat(longest, at[:-1])  # every document has a token, the 0 after it
            where = np.flatnonzero((longest > 0) & (longest == np.repeat(most, np.diff(at))))
            doc = np.searchsorted(at, where, "right") - 1
            top = where[np.append(True, np.diff(doc) > 0)] if len(where) else where  # the first of each document
            d = np.searchsorted(at, top, "right") - 1
            better = (longest[top] > best[d]) | ((longest[top] == best[d]) & (top - at[d] < best_at[d]))
            top, d = top[better], d[better]
            best[d], best_at[d], best_item[d] = longest[top], top - at[d], tests.names[whose[top]]
        return [
            pa.array(n_words, pa.int64()),
            _lists(begin - at[row], row, n, pa.int32()),
            _lists(end - at[row], row, n, pa.int32()),
            pa.array([sorted(set(x)) for x in named], pa.list_(pa.string())),
            pa.array(best, pa.int32()),
            pa.array(best_at, pa.int32(), mask=best_at < 0),
            pa.array(best_item.tolist(), pa.string()),
        ]

    return kernel


def hit_words() -> Column:
    spans = F.arrays_zip(F.col("hit_from").alias("a"), F.col("hit_to").alias("b"))
    return F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents that share no window with the benchmark, with the columns of docs, whatever their names. Null and
    empty texts stay, as does everything if the benchmark is empty; repeated rows are judged one by one."""
    new = {f.name for f in FIELDS}
    if new.isdisjoint(docs.columns):
        return matches(docs, benchmark, text, window=window).where(F.size("hit_from") == 0).select(docs.columns)
    kept = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(f"`{text}`").alias("_text"))
    return matches(kept, benchmark, "_text", window=window).where(F.size("hit_from") == 0).select("_row.*")
