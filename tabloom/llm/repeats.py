"""Removal of long verbatim repeats by suffix arrays, merged across shards.

A string of LENGTH bytes that starts twice in the corpus has equal bytes at both places, so it has the
same minimiser there (the least hash among its K-grams).  Window starts with one minimiser form a run,
and the bytes of a run with its last window are its context: equal windows lie in contexts whose
minimisers are equal K-grams.  That routes the work without losing a repeat:

1. minimisers are counted over all documents; contexts of those that occur once have no repeats;
2. equal contexts are collapsed to one with its number of places. The contexts of a minimiser go to one
   shard, of a few megabytes. A minimiser with one context may go to any: those go by the text that they
   are read from, where neighbours overlap and are held as one stretch of it;
3. every shard builds a suffix array of its bytes (Larsson-Sadakane) and Kasai's common prefixes;
   neighbours with LENGTH common bytes are one class, repeated if its places are two or more;
4. a minimiser with very many contexts is dealt to several shards. Each publishes one row for each of
   its classes, and sorted runs of those are merged by binary search, in ranges of the class key;
5. repeated windows go back to the places of their contexts and become the documents' removed spans.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.bytekit import prefix_hash, ranges, span_hash
from tabloom.llm.common import cut, hot_keys, join_hot
from tabloom.llm.docmap import add_columns, explode_rows
from tabloom.llm.suffix import common_prefixes, packed_bytes, suffix_array

LENGTH = 400
K = 100
SHARD_BYTES = 2_000_000
#: Window starts of a text whose lone contexts go to a shard together.
STRETCH = 250_000
#: Distinct contexts of one minimiser in a shard.
MOST_CONTEXTS = 2_000
_POSITION = np.uint64((1 << 28) - 1)

RUN = T.StructType(
    [T.StructField(c, t) for c, t in (("anchor", T.LongType()), ("doc", T.LongType()), ("doc2", T.LongType()), ("start", T.IntegerType()), ("windows", T.IntegerType()), ("lead", T.IntegerType()), ("context", T.LongType()))]
)
CONTEXT = ["anchor", "context", "lead", "windows"]


def runs(data: np.ndarray, off: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts with one minimiser: first start, number, minimiser's place and document,
    with the running sums of the bytes' hash."""
    sums = prefix_hash(data)
    none = np.zeros(0, np.int64)
    n, span = len(data) - k + 1, length - k + 1
    if n < span:
        return none, none, none, none, sums
    at = np.arange(n)
    value = (span_hash(sums, at, at + k) & ~_POSITION) | at.astype(np.uint64)
    # Least value of each `span` places, leftmost on ties: from the end of one block and the start of the next.
    blocks = -(-n // span)
    padded = np.full(blocks * span, np.uint64(2**64 - 1))
    padded[:n] = value
    square = padded.reshape(blocks, span)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    back = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    least = (np.minimum(back[: n - span + 1], ahead[span - 1 : n]) & _POSITION).astype(np.int64)
    count = np.maximum(np.diff(off) - length + 1, 0)
    starts = ranges(off[:-1], count)
    if not len(starts):
        return none, none, none, none, sums
    doc = np.repeat(np.arange(len(count)), count)
    place = least[starts]
    new = np.append(True, (np.diff(place) != 0) | (np.diff(doc) != 0))
    head = np.flatnonzero(new)
    return starts[head], np.diff(np.append(head, len(starts))), place[head], doc[head], sums


def _document_digest(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each whole text."""
    raw = data.tobytes()
    both = np.frombuffer(b"".join(hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)), np.int64)
    return both[0::2], both[1::2]


def _anchors(length: int, k: int):
    def kernel(data: np.ndarray, off: np.ndarray, rows: pa.RecordBatch) -> list[pa.Array]:
        _, _, place, _, sums = runs(data, off, length, k)
        return [pa.array(span_hash(sums, place, place + k).view(np.int64))]

    return kernel


def _all_runs(length: int, k: int):
    def kernel(data: np.ndarray, off: np.ndarray, rows: pa.RecordBatch) -> list[pa.Array]:
        start, count, place, doc, sums = runs(data, off, length, k)
        one, two = _document_digest(data, off)
        return [
            pa.array(span_hash(sums, place, place + k).view(np.int64)),
            pa.array(one[doc]),
            pa.array(two[doc]),
            pa.array(start - off[doc], pa.int32()),
            pa.array(count, pa.int32()),
            pa.array(place - start, pa.int32()),
            pa.array(span_hash(sums, start, start + count + length - 1).view(np.int64)),
        ]

    return kernel


def _hashed(data: np.ndarray, off: np.ndarray, rows: pa.RecordBatch) -> list[pa.Array]:
    return [pa.array(x) for x in _document_digest(data, off)]


DIGEST = [RUN["doc"], RUN["doc2"]]


DECIDED = T.StructType(
    [T.StructField("anchor", T.LongType()), T.StructField("context", T.LongType()), T.StructField("lead", T.IntegerType()), T.StructField("windows", T.IntegerType()), T.StructField("place", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("class", T.LongType()), T.StructField("weight", T.LongType())]
)


def _decide(length: int):
    """Of a shard's contexts: stretches [place, last] of repeated windows (class null); and of those of
    divided minimisers every window with its class, and on the first window of a class its weight here."""

    def shard(table: pa.Table) -> pa.Table:
        held = pa.concat_arrays(table.column("held").chunks)
        row, each = np.repeat(np.arange(len(held)), held.value_lengths().to_numpy()), held.flatten()
        cols = {c: each.field(c).to_numpy() for c in (*CONTEXT, "n", "at")} | {"divided": table.column("divided").to_numpy()[row]}
        texts = table.column("bytes").to_pylist()
        cols["at"] = cols["at"] + np.concatenate(([0], np.cumsum([len(t) for t in texts])))[row]
        _, first = np.unique(np.rec.fromarrays([cols[c] for c in CONTEXT]), return_index=True)  # repeated rows give a context twice
        cols = {c: v[first] for c, v in cols.items()}
        # Bytes between contexts are left out; overlapping contexts share theirs.
        whole = np.frombuffer(b"".join(texts), np.uint8)
        change = np.zeros(len(whole) + 1, np.int64)
        np.add.at(change, cols["at"], 1)
        np.add.at(change, cols["at"] + cols["windows"] + (length - 1), -1)
        covered = np.cumsum(change[:-1]) > 0
        base = (np.cumsum(covered) - 1)[cols["at"]]
        data = np.concatenate((whole[covered], np.full(512, 255, np.uint8)))
        packed = packed_bytes(data)
        order = suffix_array(packed, 8, len(data) + 1)  # Kasai's rule needs the order of whole suffixes
        prefix = common_prefixes(packed, order, length)
        owner = np.full(len(data), -1, np.int64)  # the context of each window start
        count = cols["windows"].astype(np.int64)
        owner[ranges(base, count)] = np.repeat(np.arange(len(base)), count)
        group = np.cumsum(prefix < length)  # class of each suffix, in order
        mine = np.flatnonzero(owner[order] >= 0)
        place, group = order[mine], group[mine]
        new = np.append(True, np.diff(group) != 0)
        number = np.cumsum(new) - 1
        weight = np.bincount(number, cols["n"][owner[place]])
        divided = cols["divided"][owner[place]].astype(bool)
        sure = np.sort(place[~divided & (weight[number] >= 2)])
        whose = owner[sure]
        edge = np.append(True, (np.diff(sure) != 1) | (np.diff(whose) != 0)) if len(sure) else np.zeros(0, bool)
        head = np.flatnonzero(edge)
        tail = np.append(head[1:], len(sure))[: len(head)] - 1
        begin, end, whose = sure[head], sure[tail], whose[head]
        parts = [(whose, begin - base[whose], end - base[whose], np.zeros(len(whose), np.int64), np.zeros(len(whose), np.int64), np.ones(len(whose), bool))]
        if divided.any():
            p, leads = place[divided], new[divided]
            key = span_hash(prefix_hash(data), p, p + length).view(np.int64)
            parts.append((owner[p], p - base[owner[p]], p - base[owner[p]], key, np.where(leads, weight[number[divided]], 0).astype(np.int64), np.zeros(len(p), bool)))
        whose, begin, end, key, weights, no_key = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pa.table(
            [*(pa.array(cols[c][whose], pa.int64() if k < 2 else pa.int32()) for k, c in enumerate(CONTEXT)), pa.array(begin, pa.int32()), pa.array(end, pa.int32()), pa.array(key, pa.int64(), mask=no_key), pa.array(weights, pa.int64(), mask=no_key)],
            names=DECIDED.names,
        )

    return shard


def _merge(table: pa.Table) -> pa.Table:
    """Classes (anchor, class) with two places or more, from the published rows of all shards in a range
    of class keys: each is looked up by binary search in the sorted rows of all."""
    anchor, key, weight = (table.column(c).to_numpy() for c in ("anchor", "class", "weight"))
    by = np.lexsort((anchor, key))
    anchor, key, weight = anchor[by], key[by], weight[by]
    mixed = np.rec.fromarrays([key, anchor])
    distinct = np.unique(mixed)
    total = np.concatenate(([0], np.cumsum(weight)))
    places = total[np.searchsorted(mixed, distinct, "right")] - total[np.searchsorted(mixed, distinct, "left")]
    found = distinct[places >= 2]
    return pa.table([pa.array(np.ascontiguousarray(found.f1)), pa.array(np.ascontiguousarray(found.f0))], names=["anchor", "class"])


def repeated_spans(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """(doc, doc2, spans): for each distinct text with repeats, by its digest, the stretches [from, to) of bytes
    that repeated strings of `length` cover; they may overlap. docs has the columns id and text."""
    texts = docs.where(F.octet_length("text") >= length)
    counts = explode_rows(texts.select("text"), _anchors(length, k), T.StructType([RUN["anchor"]])).groupBy("anchor").count().where("count > 1")
    counts = cut(counts)
    hot = hot_keys(counts, "anchor", "count", counts.agg(F.sum("count")).first()[0] or 0)
    places = join_hot(explode_rows(texts.select("text"), _all_runs(length, k), RUN), counts.select("anchor"), "anchor", hot)
    # The places of a context in copies of one text are as many places, but one document of the result.
    places = cut(places.groupBy(*RUN.names).agg(F.count("*").alias("n")))
    contexts = places.groupBy(*CONTEXT).agg(F.sum("n").alias("n"), F.count("*").alias("rows"), F.min(F.struct("doc", "doc2", "start")).alias("at"))
    contexts = cut(contexts.select(*CONTEXT, "n", "rows", "at.doc", "at.doc2", "at.start"))
    everywhere = hot_keys(contexts, "context", "rows", contexts.agg(F.sum("rows")).first()[0] or 0)
    contexts = contexts.drop("rows")
    several = cut(contexts.groupBy("anchor").count().where(F.col("count") > 1))
    varied = hot_keys(several, "anchor", "count", several.agg(F.sum("count")).first()[0] or 0)
    end = F.col("start") + F.col("windows") + F.lit(length - 1)
    held = lambda at: F.struct(*CONTEXT, "n", at.cast("int").alias("at"))
    alone = join_hot(contexts, several, "anchor", varied, "left_anti").withColumn("piece", F.floor(F.col("start") / F.lit(STRETCH)))
    alone = alone.groupBy("doc", "doc2", "piece").agg(F.min("start").alias("lo"), F.max(end).alias("hi"), F.sum(end - F.col("start")).alias("size"), F.collect_list(held(F.col("start"))).alias("held"))
    inside = F.transform("held", lambda x: x.withField("at", x["at"] - F.col("lo")))
    alone = alone.select("doc", "doc2", F.xxhash64("doc", "piece").alias("route"), F.lit(False).alias("divided"), "lo", "hi", F.least("size", F.col("hi") - F.col("lo")).alias("size"), inside.alias("held"))
    parts = F.ceil(F.col("count") / F.lit(MOST_CONTEXTS))
    mixed = join_hot(contexts, several, "anchor", varied).withColumn("divided", parts > 1)
    route = F.xxhash64("anchor", F.when(F.col("divided"), F.pmod(F.col("context"), parts)))
    mixed = mixed.select("doc", "doc2", route.alias("route"), "divided", F.col("start").alias("lo"), end.alias("hi"), (end - F.col("start")).cast("long").alias("size"), F.array(held(F.lit(0))).alias("held"))
    dealt = cut(mixed.union(alone))
    total = dealt.agg(F.sum("size")).first()[0] or 0
    shards = max(1, math.ceil(total / SHARD_BYTES))

    dealt = dealt.withColumn("shard", F.pmod("route", F.lit(shards)))
    wanted = dealt.groupBy("doc", "doc2").agg(F.collect_list(F.struct("shard", "divided", "lo", "hi", "held")).alias("wanted"))
    # One row of each wanted text: the least id. (Rows with the same id and text give contexts twice; shards drop those.)
    hashed = add_columns(texts.select("id", "text"), _hashed, DIGEST)
    holders = hashed.groupBy("doc", "doc2").agg(F.min("id").alias("id"))
    wanted = wanted.join(holders, ["doc", "doc2"])
    same = (F.col("h.doc") == F.col("w.doc")) & (F.col("h.doc2") == F.col("w.doc2")) & F.col("h.id").eqNullSafe(F.col("w.id"))
    cuts = hashed.alias("h").join(wanted.alias("w"), same).select(F.inline("wanted"), F.encode("text", "UTF-8").alias("raw"))
    cuts = cuts.select("shard", "divided", "held", F.substring(F.col("raw"), F.col("lo") + 1, F.col("hi") - F.col("lo")).alias("bytes"))
    decided = cut(cuts.groupBy("shard").applyInArrow(_decide(length), DECIDED))

    sure = decided.where("class is null").select(*CONTEXT, "place", "last")
    windows = decided.where("class is not null")
    published = windows.where("weight > 0").select("anchor", "class", "weight").withColumn("range", F.shiftrightunsigned("class", 64 - max(1, math.ceil(math.log2(shards + 1)))))
    common = published.groupBy("range").applyInArrow(_merge, "anchor long, class long")
    crossing = windows.join(common, ["anchor", "class"]).select(*CONTEXT, "place", F.col("place").alias("last"))
    stretches = sure.union(crossing).groupBy(*CONTEXT).agg(F.collect_list(F.struct("place", "last")).alias("found"))

    back = join_hot(places.select("context", *(c for c in CONTEXT if c != "context"), "doc", "doc2", "start"), stretches, ["context", *(c for c in CONTEXT if c != "context")], everywhere)
    moved = F.transform("found", lambda x: F.struct((x["place"] + F.col("start")).alias("from"), (x["last"] + F.col("start") + F.lit(length)).alias("to")))
    return back.select("doc", "doc2", moved.alias("spans")).groupBy("doc", "doc2").agg(F.flatten(F.collect_list("spans")).alias("spans"))


REMOVED = [
    T.StructField("n_bytes", T.LongType()),
    T.StructField("n_removed", T.LongType()),
    T.StructField("n_spans", T.LongType()),
    T.StructField("kept_sha256", T.StringType()),
    T.StructField("kept", T.BinaryType()),
]


def _removal(with_kept: bool):
    def kernel(data: np.ndarray, off: np.ndarray, rows: pa.RecordBatch) -> list[pa.Array]:
        spans = rows.column("spans")
        flat = spans.flatten()
        row = np.repeat(np.arange(len(spans)), spans.value_lengths().fill_null(0).to_numpy())
        change = np.zeros(len(data) + 1, np.int64)
        if len(row):
            np.add.at(change, flat.field("from").to_numpy() + off[row], 1)
            np.add.at(change, flat.field("to").to_numpy() + off[row], -1)
        gone = np.cumsum(change[:-1]) > 0
        edge = np.zeros(len(data) + 1, bool)
        edge[off] = True
        begins = gone & (np.append(False, ~gone[:-1])[: len(gone)] | edge[:-1])
        removed, begun = (np.concatenate(([0], np.cumsum(x))) for x in (gone, begins))
        kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)]
        return [
            pa.array(np.diff(off), pa.int64()),
            pa.array(np.diff(removed[off]), pa.int64()),
            pa.array(np.diff(begun[off]), pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
            pa.array(kept if with_kept else [None] * len(kept), pa.binary()),
        ]

    return kernel


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, k: int = K, with_kept: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row of docs.

    Texts are UTF-8 bytes. Each byte covered by a string of `length` bytes that also starts anywhere
    else, in the same row or another, is removed; overlapping places count, and strings are those of
    the input. n_spans counts the maximal removed stretches; kept (null unless with_kept) are the
    bytes that stay, which may break a character. Null texts are empty, and shorter texts lose
    nothing. Repeated rows repeat each other's strings. An empty table gives no rows; other columns
    aren't read.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    spans = repeated_spans(rows, length, k)
    hashed = add_columns(rows, _hashed, DIGEST)
    joined = hashed.join(spans, ["doc", "doc2"], "left").select("id", "text", "spans")
    out = add_columns(joined, _removal(with_kept), REMOVED, drop=("text", "spans"))
    return out.withColumnRenamed("id", doc_id)
