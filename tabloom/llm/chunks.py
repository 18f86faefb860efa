"""Substring deduplication by content-defined chunks.

A gear rolling hash of the last 16 bytes decides where a text may be cut, so the chunks of a passage
are the same wherever it stands and however the text before it has shifted. Chunks are known by a
digest of 96 bits, of two independent hashes. Each digest is owned by the document of the smallest id that holds it; elsewhere, and
at later places in its owner, the chunk is a repeat, and runs of neighbouring repeats of MIN_RUN
bytes or more are removed.

Only digests with ids are shuffled, one for each distinct chunk of a document: first to count and
own digests, which Spark sums up before the shuffle, then to join the repeated digests back. Places
are not shuffled, for the last step cuts the text again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.bytekit import mix, prefix_hash, span_hash
from tabloom.llm.common import cut
from tabloom.llm.docmap import add_columns, explode_rows

#: Bytes that decide a cut, least and most bytes of a chunk, and the share of places that are cuts (1 in 2^CUT_BITS).
WINDOW, LEAST, MOST, CUT_BITS = 16, 16, 256, 5
#: Shorter runs of repeated chunks stay: a common line or notice of up to 15 words or so is no passage.
MIN_RUN = 100

_gear = np.random.default_rng(424243).integers(0, 1 << 16, 256, dtype=np.uint16)


def cut_places(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of all chunks of all documents, in order; no chunk crosses documents or splits a character."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    h = _gear[data]
    step = 1
    while step < WINDOW:  # h = (h << 1) + gear, unrolled: the older half is shifted by its distance
        shifted = np.zeros_like(h)
        shifted[step:] = h[:-step] << np.uint16(step)
        h = h + shifted
        step *= 2
    begins = off[:-1][np.diff(off) > 0]
    whole = (data & 0xC0) != 0x80
    found = np.flatnonzero((h[:-1] >> np.uint16(16 - CUT_BITS) == 0) & whole[1:]) + 1
    found = found[found - begins[np.searchsorted(begins, found, "right") - 1] >= WINDOW]
    # A place is a cut only if no other place lies within the LEAST bytes before it.
    found = found[np.append(True, np.diff(found) >= LEAST)[: len(found)]]
    places = np.union1d(found, begins)
    size = np.diff(np.append(places, n))
    more = (size - 1) // MOST
    if more.any():
        forced = np.repeat(places, more) + MOST * (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1)
        for _ in range(3):
            forced = forced - ~whole[forced]
        places = np.union1d(places, forced)
    return places


def _chunks(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, documents and digests of the chunks."""
    starts = cut_places(data, off)
    ends = np.append(starts[1:], len(data))[: len(starts)]
    return starts, ends, np.searchsorted(off, starts, "right") - 1, span_hash(prefix_hash(data), starts, ends)


def _pairs(data: np.ndarray, off: np.ndarray, rows: pa.RecordBatch) -> list[pa.Array]:
    starts, ends, doc, digest = _chunks(data, off)
    check = (span_hash(prefix_hash(data, True), starts, ends, True) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    by = np.lexsort((digest, doc))
    doc, digest, check = doc[by], digest[by], check[by]
    first = np.append(True, (np.diff(doc) != 0) | (digest[1:] != digest[:-1]))[: len(doc)]
    ids, texts = rows.column("_key").to_numpy(), rows.column("_t").to_numpy()
    return [pa.array(digest[first].view(np.int64)), pa.array(check[first]), pa.array(ids[doc[first]]), pa.array(texts[doc[first]])]


PAIR = T.StructType([T.StructField("digest", T.LongType()), T.StructField("check", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("t", T.LongType())])


REMOVED = [
    T.StructField("n_bytes", T.LongType()),
    T.StructField("n_chunks", T.LongType()),
    T.StructField("n_removed", T.LongType()),
    T.StructField("n_runs", T.LongType()),
    T.StructField("kept", T.StringType()),
]


def _removal(min_run: int):
    def kernel(data: np.ndarray, off: np.ndarray, rows: pa.RecordBatch) -> list[pa.Array]:
        starts, ends, doc, digest = _chunks(data, off)
        n = len(off) - 1
        known = rows.column("_gone")
        salt = mix(np.arange(n, dtype=np.uint64) + np.uint64(1))
        lengths = known.value_lengths().fill_null(0).to_numpy()
        gone = mix(known.flatten().to_numpy().astype(np.int64).view(np.uint64) ^ np.repeat(salt, lengths))
        own = mix(digest ^ salt[doc])
        by = np.argsort(own, kind="stable")
        later = np.zeros(len(own), bool)  # not the first place of this chunk in its document
        later[by[1:]] = own[by[1:]] == own[by[:-1]]
        repeat = later | np.isin(own, gone)
        edge = np.append(True, (repeat[1:] != repeat[:-1]) | (doc[1:] != doc[:-1]))[: len(doc)]
        run = np.cumsum(edge) - 1
        size = np.bincount(run, ends - starts) if len(run) else np.zeros(0)
        repeat &= size[run] >= min_run if len(run) else False
        keep = np.repeat(~repeat, ends - starts)
        removed = np.bincount(doc, (ends - starts) * repeat, n).astype(np.int64)
        texts = [data[a:b][keep[a:b]].tobytes().decode("utf-8", "replace") for a, b in zip(off[:-1], off[1:], strict=True)]
        return [
            pa.array(np.diff(off), pa.int64()),
            pa.array(np.bincount(doc, minlength=n).astype(np.int64)),
            pa.array(removed),
            pa.array(np.bincount(doc[repeat & edge], minlength=n).astype(np.int64)),
            pa.array(texts, pa.string()),
        ]

    return kernel


def _key(doc_id: str, text: str) -> Column:
    """Order of ownership: the id; texts without one come last, in the order of a hash."""
    late = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), 2)
    return F.coalesce(F.col(doc_id).cast("long"), late)


def _deduped(docs: DataFrame, doc_id: str, text: str, min_run: int, keep: tuple[str, ...]) -> DataFrame:
    """dedup_substrings with the id as _id and the columns named in keep as _k0, _k1, ..."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("text"), *(F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)))
    rows = rows.withColumns({"_key": _key("_id", "text"), "_t": F.xxhash64("text")})
    pairs = explode_rows(rows.where(F.octet_length("text") > 0).select("_key", "_t", "text"), _pairs, PAIR)
    owners = cut(pairs.groupBy("digest", "check").agg(F.min("key").alias("owner"), F.max("key").alias("last")).where("owner < last").select("digest", "check", "owner"))
    # Each text gets the digests that it holds itself, so rows of one id don't gather in one list.
    gone = pairs.join(owners, ["digest", "check"]).where("key <> owner").groupBy("key", "t").agg(F.collect_set("digest").alias("_gone"))
    joined = rows.join(gone.withColumnsRenamed({"key": "_key", "t": "_t"}), ["_key", "_t"], "left").drop("_key", "_t")
    out = add_columns(joined, _removal(min_run), REMOVED, drop=("text", "_gone"))
    return out.select("_id", *(f"_k{i}" for i in range(len(keep))), *(f.name for f in REMOVED))


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_run: int = MIN_RUN) -> DataFrame:
    """(doc_id, n_bytes, n_chunks, n_removed, n_runs, kept) for every row of docs.

    kept is the text without its repeats: of every chunk that occurs more than once, in the same text
    or in others, the one place stays that comes first in the document of the smallest id, unless the
    run of repeats it stands in has fewer than min_run bytes. Rows that share an id count as one document
    and take nothing from each other; rows without id come after all others, and equal ones of them are one
    document. Null texts have no chunks and come out empty; texts are cut between characters.
    An empty table gives no rows.
    """
    return _deduped(docs, doc_id, text, min_run, ()).withColumnRenamed("_id", doc_id)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs, with their columns, whose texts have lost their repeats; n_chars follows if it is there. A
    document of which nothing but white space is left goes, unless it had nothing else before. A null text stays as an
    empty one; rows that share an id, or have none, are as in dedup_substrings; other columns keep their values
    whatever their names, and an empty table gives none."""
    names = docs.columns
    others = tuple(c for c in names if c not in ("doc_id", "text"))
    out = _deduped(docs, "doc_id", "text", MIN_RUN, others).where("n_removed = 0 or trim(kept) <> ''")
    made = {"doc_id": F.col("_id"), "text": F.col("kept")} | {c: F.col(f"_k{i}") for i, c in enumerate(others)}
    if "n_chars" in names:
        made["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(made["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return out.select(*(made[c].alias(c) for c in names))
