"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a byte string the encoding is unique, and so is its last token; dropping that token leaves the
encoding of a shorter prefix. So one array with the last token of each prefix holds the encodings of all prefixes. The
last token of a prefix is the token that ends there and stands validly after the last token of the prefix before it;
two tokens stand validly next to each other if the merges of their joined bytes end in just these two.

The array makes appends exact without starting again, and after an edit it has to be computed anew only until as many
entries as the longest token has bytes come out as before (`Prefixes`). Texts are split by a pattern first, and the parts that
a text cuts into before spaces are encoded once a worker (`Encoder`).
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parts of texts, and as many pieces of parts, that a generation of a worker's memory holds; ones longer than MEMO_CHARS are
#: not remembered.
MEMO = 250_000
MEMO_CHARS = 64


def read_ranks(path: str) -> list[bytes]:
    """Bytes of the tokens of a rank file, by rank."""
    with open(path, "rb") as lines:
        ranks = dict((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in lines if line.strip()))
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks are to be 0, 1, ... without gaps")
    return [ranks[k] for k in range(len(ranks))]


class Merges:
    """How each token is made of two, and which tokens stand validly next to each other."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens = tokens
        self.rank = {token: k for k, token in enumerate(tokens)}
        self.made: dict[tuple[int, int], int] = {}
        self.left, self.right = list(range(len(tokens))), list(range(len(tokens)))
        self.known: dict[int, bool] = {}
        self.reached = [len(token) == 1 for token in tokens]
        self.longest = max(map(len, tokens), default=0)
        for k, token in enumerate(tokens):
            for at in range(1, len(token)):
                a, b = self.rank.get(token[:at]), self.rank.get(token[at:])
                # The two parts that are merged last: made before, and not merged otherwise until then.
                if a is not None and b is not None and a < k and b < k and self.reached[a] and self.reached[b] and self._stand(a, b):
                    self.made[a, b] = k
                    self.left[k], self.right[k] = a, b
                    self.reached[k] = True
                    break

    def _stand(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b joined are merged to a, b: undo the merges of both from the last one on; none of the
        pairs that meet at the border may have been merged before the parts that they are."""
        limit = len(self.tokens)
        while True:
            if self.made.get((a, b), limit) < limit:
                return False
            if a > b:
                limit, whole = a, a
                a = self.right[a]
                if a == whole:
                    limit, whole = b + 1, b
                    b = self.left[b]
                    if b == whole:
                        return True
            else:
                limit, whole = b + 1, b
                b = self.left[b]
                if b == whole:
                    limit, whole = a, a
                    a = self.right[a]
                    if a == whole:
                        return True

    def stand(self, a: int, b: int) -> bool:
        key = a * len(self.tokens) + b
        if (known := self.known.get(key)) is None:
            if len(self.known) > 4_000_000:
                self.known.clear()
            known = self.known[key] = self._stand(a, b)
        return known


class Prefixes:
    """A byte string that can be changed, with the unique last token of each of its prefixes."""

    def __init__(self, merges: Merges, data: bytes = b"") -> None:
        self.merges, self.data, self.last = merges, b"", [-1]
        self.append(data)

    def _token(self, end: int) -> int:
        merges, data, last = self.merges, self.data, self.last
        for n in range(min(end, merges.longest), 0, -1):
            token = merges.rank.get(data[end - n : end])
            if token is not None and merges.reached[token] and (n == end or merges.stand(last[end - n], token)):
                return token
        raise ValueError("a byte that is no token")

    def append(self, more: bytes) -> None:
        """Exact, and only the new prefixes are looked at."""
        first, self.data = len(self.data) + 1, self.data + more
        for end in range(first, len(self.data) + 1):
            self.last.append(self._token(end))

    def replace(self, at: int, removed: int, put: bytes) -> int:
        """Put bytes in place of `removed` ones; the number of prefixes that were looked at. Prefixes up to `at` are kept, and
        those behind the edit from where as many as the longest token has bytes are as before."""
        old, gone = self.last, at + removed
        self.data = self.data[:at] + put + self.data[gone:]
        self.last, same, shift = old[: at + 1], 0, len(put) - removed
        for end in range(at + 1, len(self.data) + 1):
            token = self._token(end)
            self.last.append(token)
            before = end - shift
            same = same + 1 if before > gone and old[before] == token else 0
            if same >= self.merges.longest:
                self.last += old[before + 1 :]
                return end - at
        return len(self.data) - at

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end])
            end -= len(self.merges.tokens[out[-1]])
        return out[::-1]


class Memory:
    """Ids by text, in two generations: when the young one has MEMO entries it becomes the old one, and the old one is dropped.
    What is asked for stays, the rest goes, and there are never more than twice MEMO entries."""

    def __init__(self) -> None:
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, text: str) -> bytes | None:
        if (ids := self.young.get(text)) is None and (ids := self.old.get(text)) is not None:
            self.put(text, ids)
        return ids

    def put(self, text: str, ids: bytes) -> bytes:
        if len(text) <= MEMO_CHARS:
            if len(self.young) >= MEMO:
                # The dict that a caller holds on to stays the young one.
                self.old = dict(self.young)
                self.young.clear()
            self.young[text] = ids
        return ids


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Ids of texts, with a memory of parts; one a worker and vocabulary."""

    def __init__(self, tokens: list[bytes], pattern: str) -> None:
        self.merges = Merges(tokens)
        self.pattern = regex.compile(pattern)
        self.machine = ahocorasick.Automaton()
        for k, token in enumerate(tokens):
            if self.merges.reached[k]:
                self.machine.add_word(token.decode("latin-1"), (k, len(token)))
        self.machine.make_automaton()
        self.size = [len(token) for token in tokens]
        self.pieces, self.parts = Memory(), Memory()
        #: White space before a space: such a text cannot simply be cut before each space.
        self.gap = regex.compile(r"\s ")

    def piece(self, piece: str) -> bytes:
        """Ids of one match of the pattern."""
        data = piece.encode()
        if (whole := self.merges.rank.get(data)) is not None:
            return _pack([whole])
        last, known, n, done = [-1] * (len(data) + 1), self.merges.known, len(self.size), -1
        for at, (token, size) in self.machine.iter(piece if len(data) == len(piece) else data.decode("latin-1")):
            if at == done:
                continue
            if (before := at + 1 - size) and not known.get(key := last[before] * n + token):
                # A prefix always has a last token, as every byte is a token.
                if key in known or not self.merges.stand(last[before], token):
                    continue
            last[at + 1], done = token, at
        out, end, size_of = [], len(data), self.size
        while end:
            out.append(last[end])
            end -= size_of[last[end]]
        return _pack(out[::-1])

    def part(self, part: str) -> bytes:
        """Ids of a stretch of text that matches don't cross."""
        return b"".join([self.pieces.get(piece) or self.pieces.put(piece, self.piece(piece)) for piece in self.pattern.findall(part)])

    def text(self, text: str) -> bytes:
        """Matches of the pattern never go from other characters on to a space, so texts are cut before the spaces behind them."""
        if not text:
            return b""
        if self.gap.search(text):
            return self.part(text)
        first, *rest = text.split(" ")
        young, get = self.parts.young.get, self.parts.get
        # No part is without ids: each has its space.
        return self.part(first) + b"".join([young(part) or get(part) or self.parts.put(part, self.part(" " + part)) for part in rest])

    def decode(self, ids: bytes) -> bytes:
        tokens = self.merges.tokens
        return b"".join([tokens[k] for k in np.frombuffer(ids, "<u4").tolist()])

    def edit(self, old: str, ids: bytes, at: int, removed: int, put: str) -> tuple[str, bytes]:
        """The new text and its ids, from those of the old one; `at` and `removed` count characters. An append is an edit at the end.

        A space behind another character than white space begins a match whatever stands elsewhere. So the ids up to the
        last such space before the edit stay, and those from the first such space behind it on."""
        at = max(0, min(at, len(old)))
        gone = min(len(old), at + max(0, removed))
        head = at - 1
        while head > 0 and not self._border(old, head):
            head -= 1
        head, tail = max(0, head), gone + 1
        while tail < len(old) and not self._border(old, tail):
            tail += 1
        tail = min(tail, len(old))
        sizes = np.array(self.size)[np.frombuffer(ids, "<u4")]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        n_head = int(np.searchsorted(ends, len(old[:head].encode())))
        n_tail = int(np.searchsorted(ends, ends[-1] - len(old[tail:].encode())))
        middle = self.text(old[head:at] + put + old[gone:tail])
        return old[:at] + put + old[gone:], ids[: 4 * n_head] + middle + ids[4 * n_tail :]

    @staticmethod
    def _border(text: str, at: int) -> bool:
        return text[at] == " " and not text[at - 1].isspace()


_ENCODERS: dict[tuple[int, str], Encoder] = {}


def _encoder(tokens: list[bytes], pattern: str) -> Encoder:
    """The worker's encoder: tables are built once a worker, not once a task."""
    key = hash(tuple(tokens)), pattern
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(tokens, pattern)
    return _ENCODERS[key]


#: Texts that are Python strings at once.
BATCH_ROWS = 256


def _map(df: DataFrame, tokens: list[bytes], pattern: str, reads: list[str], new: dict[str, T.DataType], row) -> DataFrame:
    """df with the columns `new`, made for each row from the columns `reads` by row(encoder, *values); old columns of these names
    are replaced, others stay."""
    held = df.sparkSession.sparkContext.broadcast(tokens)
    kept = [c for c in df.columns if c not in new]
    work = df.select(*(F.col(f"`{c}`") for c in kept), *(F.col(f"`{c}`").alias(f"_in{k}") for k, c in enumerate(reads)))
    fields = [work.schema[c] for c in kept] + [T.StructField(c, kind) for c, kind in new.items()]
    kinds = [pa.int64() if kind == T.LongType() else pa.string() if kind == T.StringType() else pa.binary() for kind in new.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(held.value, pattern)
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(start, BATCH_ROWS)
                inputs = [batch.column(len(kept) + k).to_pylist() for k in range(len(reads))]
                made = [row(encoder, *values) for values in zip(*inputs, strict=True)]
                columns = [pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(len(kept))] + columns, names=[f.name for f in fields])

    return work.mapInArrow(run, T.StructType(fields))


def encode(docs: DataFrame, ranks: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with `n_tokens` (long) and `ids` (binary: little-endian unsigned 32-bit integers) of each whole text.

    `ranks` is the path of a rank file on the driver; the vocabulary goes to the tasks in a broadcast. A map without a
    shuffle. Null and empty texts have no tokens; texts may be of any length; repeated rows each stay; an empty table gives
    an empty one. Other columns stay, those named n_tokens or ids are replaced. Special tokens don't exist."""

    def row(encoder: Encoder, value: str | None) -> tuple[int, bytes]:
        ids = encoder.text(value or "")
        return len(ids) // 4, ids

    return _map(docs, read_ranks(ranks), pattern, [text], {"n_tokens": T.LongType(), "ids": T.BinaryType()}, row)


def decode(encoded: DataFrame, ranks: str, ids: str = "ids") -> DataFrame:
    """encoded with `decoded` (binary), the bytes of the tokens of `ids`; null ids give no bytes. Other columns stay."""

    def row(encoder: Encoder, value: bytes | None) -> tuple[bytes]:
        return (encoder.decode(bytes(value or b"")),)

    return _map(encoded, read_ranks(ranks), "", [ids], {"decoded": T.BinaryType()}, row)


def edit_encoded(encoded: DataFrame, edits: DataFrame, ranks: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """encoded (key, text, ids, ...) after one edit a document at most (key, at, removed, put; characters), with new `text`, `ids`
    and `n_tokens`: ids away from the edit are kept. A null `at` is the end of the text, so the edit is an append; null `removed`
    and `put` are 0 and nothing. Documents without an edit stay as they are; edits of unknown documents do nothing."""
    one = edits.select(key, F.col("at").alias("_at"), F.col("removed").alias("_removed"), F.col("put").alias("_put"), F.lit(True).alias("_edited"))
    joined = encoded.join(one, key, "left")

    def row(encoder: Encoder, text, ids, at, removed, put, edited) -> tuple[int, str | None, bytes]:
        if edited:
            old = text or ""
            text, ids = encoder.edit(old, bytes(ids or b""), len(old) if at is None else at, removed or 0, put or "")
        return len(ids or b"") // 4, text, ids

    new = {"n_tokens": T.LongType(), "text": T.StringType(), "ids": T.BinaryType()}
    made = _map(joined, read_ranks(ranks), pattern, ["text", "ids", "_at", "_removed", "_put", "_edited"], new, row)
    return made.select(*encoded.columns)
