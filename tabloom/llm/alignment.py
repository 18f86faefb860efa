"""Alignment of the tokens of two tokenizers, by byte ranges.

Texts are cut before runs of white space, wherever neither vocabulary has a token across; so the tokens of a text are those of
its segments, one after the other. Each task numbers the distinct segments of a batch of documents; distinct segments
are tokenised and aligned once in the corpus, and the alignments join the batches that asked for them, where documents are
composed from them. How many documents hold a pair of ids linked is added up over batches, and the sums join the batches again.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tabloom.llm.bytekit import ranges
from tabloom.llm.common import discard, written

#: UTF-8 text of a batch, more only where a single document is longer.
BATCH_BYTES = 16_000_000
#: Text that is tokenised at once.
CHUNK_BYTES = 100_000
SPACE = "▁"
#: What a segment is tokenised behind, so that nothing is added to it or taken from it.
LEAD = "x"
#: Numbers of A and B tokens of a segment. Their ids follow, then for each A token twice the number of its links, and one more
#: where it ends a group: a segment's alignment, as its next A token begins at the B token where the last one ended or, behind
#: the end of a group, at the one after that.
HEAD = struct.Struct("<2I")
RESULTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


class Pair:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, a_json: str, b_model: bytes) -> None:
        spec = json.loads(a_json)
        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=b_model)
        byte_of = {chr(k): v for k, v in _byte_level().items()}
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.a_bytes[k] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        pieces = [(k, self.b.id_to_piece(k)) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(SPACE, " ").encode() for k, p in pieces]
        self.blocked = self._blocked(spec)
        self.dtype = np.dtype("<u2" if max(len(self.a_bytes), len(self.b_bytes)) <= 2**16 else "<u4")
        self.a_size = np.array([len(t) for t in self.a_bytes])
        self.b_size = np.array([len(t) for t in self.b_bytes])
        # Ids as text, with what comes behind: a comma, or at the end of a group's side a bar or semicolon.
        self.word = [f"{k}{end}" for k in range(len(self.a_bytes)) for end in ",|"] + [f"{k}{end}" for k in range(len(self.b_bytes)) for end in ",;"]
        self.a_lead, self.b_lead = len(self.a.encode(LEAD, add_special_tokens=False).ids), len(self.b.encode(LEAD))

    def _blocked(self, spec: dict) -> str:
        """Characters behind which a space doesn't begin a segment, besides white space: those before a space within a piece of B.
        A's merges stay within the matches of its pattern, none of which goes on to a space. Where A splits or B normalises in
        another way nothing could be said, so that is refused."""
        split = spec.get("pre_tokenizer") or {}
        if split.get("type") != "ByteLevel" or not split.get("use_regex", True) or split.get("add_prefix_space") or spec.get("normalizer") or spec.get("post_processor"):
            raise ValueError("A is to be a byte-level BPE with its usual split, without prefix space or normaliser")
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size()) if not self.b.is_byte(k)]
        before = {p[k - 1] for p in pieces for k in range(1, len(p)) if p[k] == SPACE and p[k - 1] != SPACE}
        if LEAD in before:
            raise ValueError(f"B has pieces that go on from {LEAD} to a space")
        probe = f"{LEAD}  {LEAD}  "
        if self._joined(self.b.encode(probe)) != f" {probe}".encode():
            raise ValueError("B is to add a space and to keep all others")
        return "".join(sorted(before))

    def _joined(self, ids: list[int]) -> bytes:
        return b"".join([self.b_bytes[k] for k in ids])

    def payloads(self, segments: list[str]) -> list[bytes]:
        """HEAD, ids and codes of each segment; nothing for one whose tokens don't spell it."""
        out: list[bytes] = []
        at = 0
        while at < len(segments):
            size, end = 0, at
            # A segment that ends where the next one's space begins no segment is tokenised alone.
            while end < len(segments) and size < CHUNK_BYTES:
                size += len(segments[end])
                end += 1
                if self._open(segments[end - 1]):
                    break
            out += self._chunk(segments[at:end])
            at = end
        return out

    def _open(self, segment: str) -> bool:
        last = segment[-1]
        return last.isspace() or last in self.blocked or last == "\x85"

    def _chunk(self, segments: list[str]) -> list[bytes]:
        text = "".join(segments)
        a_ids = self.a.encode(LEAD + text, add_special_tokens=False).ids[self.a_lead :]
        b_ids = self.b.encode(LEAD + text)[self.b_lead :]
        data = text.encode()
        if b"".join([self.a_bytes[k] for k in a_ids]) != data or self._joined(b_ids) != data:
            if len(segments) == 1:
                return [b""]
            half = len(segments) // 2
            return self._chunk(segments[:half]) + self._chunk(segments[half:])
        a, b = np.array(a_ids, np.int64), np.array(b_ids, np.int64)
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        ends_group = np.isin(a_end, np.intersect1d(a_end, b_end, assume_unique=True))
        # Links: the B tokens from the one that holds an A token's first byte to the one that holds its last.
        links = np.searchsorted(b_end, a_end) - np.searchsorted(b_end, a_end - self.a_size[a], "right") + 1
        codes = (2 * links + ends_group).astype(self.dtype)
        ends = np.cumsum([len(s.encode()) for s in segments])
        a_at = np.concatenate([[0], np.searchsorted(a_end, ends, "right")]).tolist()
        b_at = np.concatenate([[0], np.searchsorted(b_end, ends, "right")]).tolist()
        a, b = a.astype(self.dtype), b.astype(self.dtype)
        out = []
        for a0, a1, b0, b1 in zip(a_at, a_at[1:], b_at, b_at[1:], strict=False):
            out.append(HEAD.pack(a1 - a0, b1 - b0) + a[a0:a1].tobytes() + b[b0:b1].tobytes() + codes[a0:a1].tobytes())
        return out


def _packed(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, all first bytes, then all second ones and so on: the high ones of small numbers are zeros in a row,
    which shuffles and files compress."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _byte_level() -> dict[int, int]:
    """Code point that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [k for k in range(256) if k not in plain]
    return {k: k for k in plain} | {256 + n: k for n, k in enumerate(rest)}


@lru_cache(maxsize=1)
def _pair(a_json: str, b_model: bytes) -> Pair:
    return Pair(a_json, b_model)


def _cutter(blocked: str):
    """Function from a text to its segments; joined, they are a space and the text."""
    stop = rf"[\s\x1c-\x1f\x85{regex.escape(blocked)}]"
    gap, border = regex.compile(stop + " "), regex.compile(rf"(?<!{stop}) ")

    def cut(text: str) -> list[str]:
        if text[0] != " " and not gap.search(text):
            return [f" {part}" for part in text.split(" ")]
        full = " " + text
        at = [0, *(m.start() for m in border.finditer(full, 1)), len(full)]
        return [full[s:e] for s, e in zip(at, at[1:], strict=False)]

    return cut


def _segments(docs: DataFrame, text: str, blocked: str) -> DataFrame:
    """Rows of batches: documents with the numbers of their segments (`kept`: their other columns), and segments by number."""
    kept = [c for c in docs.columns if c != text and c not in RESULTS and c != "groups"]
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("kept") if kept else F.struct(F.lit(None).cast("int").alias("_none")).alias("kept"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([T.StructField("batch", T.LongType()), T.StructField("kept", whole.schema["kept"].dataType), T.StructField("numbers", T.BinaryType()), T.StructField("number", T.IntegerType()), T.StructField("segment", T.StringType())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, batch, size, number = _cutter(blocked), TaskContext.get().partitionId() << 32, 0, {}
        arrow = None

        def listed() -> Iterator[pa.RecordBatch]:
            found = list(number)
            for at in range(0, len(found), 50_000):
                some = found[at : at + 50_000]
                n = len(some)
                yield pa.RecordBatch.from_arrays([pa.array([batch] * n, pa.int64()), pa.nulls(n, arrow), pa.nulls(n, pa.binary()), pa.array(range(at, at + n), pa.int32()), pa.array(some, pa.string())], names=schema.names)

        for whole_rows in rows:
            arrow = whole_rows.schema.field("kept").type
            for at in range(0, whole_rows.num_rows, 200):
                some = whole_rows.slice(at, 200)
                if size > BATCH_BYTES:
                    yield from listed()
                    batch, size, number = batch + 1, 0, {}
                numbers = []
                for value in some.column("text").to_pylist():
                    if not value:
                        numbers.append(b"")
                        continue
                    size += len(value)
                    numbers.append(_packed(np.array([number.setdefault(s, len(number)) for s in cut(value)])))
                n = some.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([batch] * n, pa.int64()), some.column("kept"), pa.array(numbers, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], names=schema.names)
        if number:
            yield from listed()

    return whole.mapInArrow(run, schema)


def _aligned(segments: DataFrame, held) -> DataFrame:
    """(batch, number, payload) of (batch, number, segment); rows of a segment come one after the other, and it is done once."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, last, payload = _pair(*held.value), None, b""
        for batch in rows:
            texts = batch.column("segment").to_pylist()
            new = [t for k, t in enumerate(texts) if t != (texts[k - 1] if k else last)]
            made = iter(pair.payloads(new))
            out = []
            for text in texts:
                if text != last:
                    last, payload = text, next(made)
                out.append(payload)
            yield pa.RecordBatch.from_arrays([batch.column("batch"), batch.column("number"), pa.array(out, pa.binary())], names=["batch", "number", "payload"])

    return segments.repartition("segment").sortWithinPartitions("segment").mapInArrow(run, "batch long, number int, payload binary")


class _Answers:
    """Alignments of a batch's segments by number."""

    def __init__(self, numbers: list[np.ndarray], payloads: list[bytes], pair: Pair) -> None:
        order = np.argsort(np.concatenate(numbers)) if numbers else np.zeros(0, np.int64)
        made = [payloads[k] for k in order.tolist()]
        self.fine = np.array([bool(p) for p in made], bool)
        made = [p or bytes(HEAD.size) for p in made]
        data, width = np.frombuffer(b"".join(made), np.uint8), pair.dtype.itemsize
        start = np.cumsum([0, *(len(p) for p in made)])[:-1]
        del made
        payloads.clear()
        n_a, n_b = data[start[:, None] + np.arange(HEAD.size)].copy().view("<u4").astype(np.int64).reshape(-1, 2).T
        part = lambda at, n: data[ranges(at, n * width)].view(pair.dtype).astype(np.int64)
        at = start + HEAD.size
        a, b, code = part(at, n_a), part(at + n_a * width, n_b), part(at + (n_a + n_b) * width, n_a)
        n, ends_group = code >> 1, code & 1
        # The first and last B token of each A token; each segment's last A token ends a group, so the next segment goes on rightly.
        step = n - 1 + ends_group
        first = np.cumsum(step) - step
        flat = a.repeat(n) << 32 | b[ranges(first, n)]
        self.pairs, self.pair_of = np.unique(flat, return_inverse=True)
        upto = lambda values: np.concatenate([[0], np.cumsum(values)])
        a_at, b_at, links = upto(n_a), upto(n_b), upto(n)[upto(n_a)]
        self.first = links[:-1]
        groups = upto(ends_group)
        self.head = np.stack([n_a, n_b, np.diff(groups[a_at]), np.diff(links)], 1)
        # The words of a group: its A ids, then its B ids.
        a_upto = np.flatnonzero(ends_group) + 1
        b_upto = (first + n)[a_upto - 1]
        words = np.empty(len(a) + len(b), np.int64)
        words[np.arange(len(a)) + np.concatenate([[0], b_upto])[groups[:-1]]] = 2 * a + ends_group
        last = np.zeros(len(b), np.int64)
        last[b_upto - 1] = 1
        words[np.arange(len(b)) + a_upto[upto(last)[:-1]]] = 2 * (len(pair.a_bytes) + b) + last
        del a, b, code, n, first, step, flat, last, data
        at, self.groups = a_at + b_at, []
        for k in range(0, len(at) - 1, 20_000):
            some = (at[k : k + 20_001] - at[k]).tolist()
            texts = [pair.word[w] for w in words[at[k] : at[min(k + 20_000, len(at) - 1)]].tolist()]
            self.groups += ["".join(texts[s:e])[:-1].encode() for s, e in zip(some, some[1:], strict=False)]
        self.documents = np.zeros(len(self.pairs), np.int64)

    def document(self, numbers: np.ndarray) -> tuple[list[int], bytes | None, bytes]:
        """Counts, joined groups, and the document's pairs, as differences of their numbers and occurrences."""
        if not len(numbers) or not self.fine[numbers].all():
            return [0] * 4, None, b""
        links = self.pair_of[ranges(self.first[numbers], self.head[numbers, 3])]
        pairs, n = np.unique(links, return_counts=True)
        self.documents[pairs] += 1
        packed = _packed(np.concatenate([np.diff(pairs, prepend=0), n]))
        return self.head[numbers].sum(0).tolist(), b";".join([self.groups[k] for k in numbers.tolist()]), packed


def _by_batch(documents: DataFrame, answers: DataFrame, tasks: int) -> DataFrame:
    """Both, a batch's answers before its documents in one partition; batches of one task in different ones, as far as there are
    others."""
    both = documents.withColumn("is_document", F.lit(True)).unionByName(answers.withColumn("is_document", F.lit(False)), allowMissingColumns=True)
    place = F.pmod(F.shiftright("batch", 32) + F.col("batch").bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(tasks))
    return both.repartitionById(tasks, place.cast("int")).sortWithinPartitions("batch", "is_document")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """(batch, whether documents, rows) of stretches of rows of one kind."""
    key = np.array(batch.column("batch").to_pylist(), np.int64) * 2 + np.array(batch.column("is_document").to_pylist(), bool)
    at = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
    for s, e in zip(at, at[1:], strict=False):
        if e > s:
            yield int(key[s] >> 1), bool(key[s] & 1), batch.slice(s, e - s)


def _composed(documents: DataFrame, answers: DataFrame, held, digest: bool, tasks: int) -> DataFrame:
    """Documents with counts, groups and pairs, and rows of each batch's pairs: ids, and documents that hold them."""
    work = _by_batch(documents, answers, tasks)
    names = ["batch", "kept", *RESULTS[:4], "groups", "packed", "pair", "a", "b", "documents"]
    long = T.LongType()
    schema = T.StructType([T.StructField("batch", long), work.schema["kept"], *(T.StructField(c, long) for c in RESULTS[:4]), T.StructField("groups", T.StringType()), T.StructField("packed", T.BinaryType()), T.StructField("pair", T.IntegerType()), *(T.StructField(c, long) for c in ("a", "b", "documents"))])

    def rows(batch: int, n: int, kept: pa.Array, **columns: pa.Array) -> pa.RecordBatch:
        kinds = {"groups": pa.string(), "packed": pa.binary(), "pair": pa.int32()}
        made = {"batch": pa.array([batch] * n, pa.int64()), "kept": kept} | columns
        return pa.RecordBatch.from_arrays([made[c] if c in made else pa.nulls(n, kinds.get(c, pa.int64())) for c in names], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, numbers, payloads, table, arrow = None, [], [], None, None

        def pairs() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(table.pairs) if table else 0, 50_000):
                some, docs = table.pairs[at : at + 50_000], table.documents[at : at + 50_000]
                yield rows(now, len(some), pa.nulls(len(some), arrow), pair=pa.array(range(at, at + len(some)), pa.int32()), a=pa.array(some >> 32), b=pa.array(some & 0xFFFFFFFF), documents=pa.array(docs))

        for arrived in batches:
            arrow = arrived.schema.field("kept").type
            for batch, is_document, some in _runs(arrived):
                if batch != now:
                    yield from pairs()
                    now, numbers, payloads, table = batch, [], [], None
                if not is_document:
                    numbers.append(np.array(some.column("number").to_pylist(), np.int64))
                    payloads += some.column("payload").to_pylist()
                    continue
                if table is None:
                    table, numbers, payloads = _Answers(numbers, payloads, _pair(*held.value)), [], []
                for at in range(0, some.num_rows, 500):
                    part = some.slice(at, 500)
                    made = [table.document(_unpacked(x)) for x in part.column("numbers").to_pylist()]
                    counts = np.array([m[0] for m in made], np.int64)
                    groups = [("" if digest else None) if m[1] is None else hashlib.sha256(m[1]).hexdigest() if digest else m[1].decode() for m in made]
                    columns = {c: pa.array(counts[:, k]) for k, c in enumerate(RESULTS[:4])}
                    yield rows(batch, part.num_rows, part.column("kept"), groups=pa.array(groups, pa.string()), packed=pa.array([m[2] for m in made], pa.binary()), **columns)
        yield from pairs()

    return work.mapInArrow(run, schema)


def _scored(documents: DataFrame, answers: DataFrame, tasks: int) -> DataFrame:
    """Documents with sums over their links of the pairs' counts, and of being an A id's best."""
    work = _by_batch(documents, answers, tasks)
    names = ["kept", *RESULTS, "groups"]
    schema = T.StructType([work.schema["kept"], *(T.StructField(c, T.LongType()) for c in RESULTS), T.StructField("groups", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, got, count, best = None, [], None, None
        for arrived in batches:
            for batch, is_document, some in _runs(arrived):
                if batch != now:
                    now, got, count = batch, [], None
                if not is_document:
                    got.append(np.array([some.column(c).to_pylist() for c in ("pair", "count", "best")], np.int64))
                    continue
                if count is None:
                    pair, *values = np.concatenate(got, 1) if got else np.zeros((3, 0), np.int64)
                    order = np.argsort(pair)
                    count, best = values[0][order], values[1][order]
                    got = []
                sums = np.zeros((some.num_rows, 2), np.int64)
                for k, packed in enumerate(some.column("packed").to_pylist()):
                    halves = _unpacked(packed).reshape(2, -1)
                    pairs = np.cumsum(halves[0])
                    sums[k] = (best[pairs] * halves[1]).sum(), (count[pairs] * halves[1]).sum()
                old = [some.column(c) for c in RESULTS[:4]]
                yield pa.RecordBatch.from_arrays([some.column("kept"), *old, pa.array(sums[:, 0]), pa.array(sums[:, 1]), some.column("groups")], names=names)

    return work.mapInArrow(run, schema)


def align(docs: DataFrame, a_json: str, b_model: str, text: str = "text", digest: bool = False) -> DataFrame:
    """docs without the text, with n_a, n_b, n_groups, n_links, n_best, count_sum (long) and groups.

    `a_json` (a byte-level BPE of the tokenizers library) and `b_model` (sentencepiece) are paths on the driver; both go to the
    tasks in a broadcast, as large as the vocabularies. A tokenises a space and the text, B the text. Byte offsets where tokens
    of both end cut the tokens into groups, written as `a1,a2|b1;a3|b2,b3` with ids in order; with `digest` that text's
    SHA-256 in hexadecimal stands for it, which saves moving it. Tokens of A and B whose byte ranges overlap are links. A pair of ids
    counts the documents that hold it linked; n_best are the links whose count is the highest of their A id, and
    count_sum adds up the counts of all links.

    A null or empty text, and one that the tokens of A or B don't spell, has zeros and no groups (null, or '' with `digest`). Texts may be of
    any length, repeated rows each stay and count, an empty table gives an empty one; other columns stay, those with the names
    of results are replaced. Tables between the steps lie in the shared folder until the end."""
    spark = docs.sparkSession
    with open(a_json) as a, open(b_model, "rb") as b:
        held = spark.sparkContext.broadcast((a.read(), b.read()))
    blocked = _pair(*held.value).blocked
    cut = written(_segments(docs, text, blocked), "segments")
    tasks = ((cut.agg(F.max("batch")).first()[0] or 0) >> 32) + 1
    answers = _aligned(cut.where("segment IS NOT NULL").select("batch", "number", "segment"), held)
    made = written(_composed(cut.where("numbers IS NOT NULL").select("batch", "kept", "numbers"), answers, held, digest, tasks), "aligned")
    discard(cut)
    asked = made.where("pair IS NOT NULL").select("batch", "pair", "a", "b", "documents")
    counts = asked.groupBy("a", "b").agg(F.sum("documents").alias("count"))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    judged = counts.join(most, "a").select("a", "b", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))
    told = asked.join(judged, ["a", "b"]).select("batch", "pair", "count", "best")
    documents = made.where("pair IS NULL").select("batch", "kept", *RESULTS[:4], "groups", "packed")
    scored = written(_scored(documents, told, tasks), "alignments")
    discard(made)
    kept = [f.name for f in scored.schema["kept"].dataType.fields if f.name != "_none"]
    return scored.select(*(F.col("kept").getField(c).alias(c) for c in kept), *RESULTS, "groups")
