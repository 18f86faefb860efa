"""Vectorised byte and word helpers shared by the text operators.

An Arrow string column already is one UTF-8 buffer with offsets, so the operators work on that
buffer with numpy: no Python string is made per document or word.  Documents of a batch are handled
in pieces of a few megabytes, so that the 64-bit arrays made from a piece stay small whatever the
batch; a document longer than that is a piece of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa

PIECE_BYTES = 2_000_000
#: Longer words have a digest made by hashlib, one by one.
LONG_WORD = 64

_rng = np.random.default_rng(20240229)
#: A random odd 64-bit value per byte, and the odd base of the rolling hash.
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
#: The same for the second hash.
SECOND_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SECOND_BASE = np.uint64(0xC2B2AE3D27D4EB4F)

#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_code = np.arange(256)
#: Bytes of words for `[^\x20\x09-\x0D]+`, and (lower-cased) for `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
NOT_SPACE = ~((_code == 32) | ((_code >= 9) & (_code <= 13)))
ALNUM = ((_code >= 48) & (_code <= 57)) | ((_code >= 97) & (_code <= 122)) | (_code >= 128)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string column without nulls, and n + 1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(column: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole documents of up to `most` bytes."""
    data, off = text_buffer(column)
    n, at = len(off) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield at, end, data[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


def words(data: np.ndarray, off: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of member bytes within documents, and the
    n + 1 offsets of each document's words among them."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    inside = member[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off[(off < len(data))]] = True
    edge[-1] = True
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off, "left")


@lru_cache(maxsize=4)
def _powers(n: int, second: bool) -> tuple[np.ndarray, np.ndarray]:
    base = SECOND_BASE if second else BASE
    up, down = np.full(n, base, np.uint64), np.full(n, np.uint64(pow(int(base), -1, 2**64)), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    up, down = _powers(1 << max(16, int(n).bit_length()), second)
    return up[:n], down[:n]


def prefix_hash(data: np.ndarray, second: bool = False) -> np.ndarray:
    """n + 1 running sums of which span_hash makes the hash of any span; `second` is another, independent hash."""
    up, _ = powers(len(data) + 1, second)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((SECOND_VALUE if second else BYTE_VALUE)[data] * up[: len(data)], out=sums[1:])
    return sums


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes give equal hashes wherever they stand."""
    _, down = powers(len(sums), second)
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
    """64-bit hashes of byte spans, each from its own bytes: eight at a time are mixed in, and every step spreads all bits, so
    unlike span_hash's sums there are no words that collide by their pattern. For spans that don't overlap."""
    held = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(held) - 7, "<u8", held, strides=(1,))
    size = ends - starts
    seed = np.uint64(0xD6E8FEB86659FD93 if second else 0xA0761D6478BD642F)
    out = mix(size.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB) ^ seed)
    long = np.flatnonzero(size > LONG_WORD)
    left = np.flatnonzero((size > 0) & (size <= LONG_WORD))
    for at in range(0, LONG_WORD, 8):
        left = left[size[left] > at]
        if not len(left):
            break
        rest = np.minimum(size[left] - at, 8).astype(np.uint64)
        part = eight[starts[left] + at] & (np.uint64(2**64 - 1) >> (np.uint64(64) - np.uint64(8) * rest))
        out[left] = mix((out[left] ^ mix(part + seed)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(at + 1))
    for k in long.tolist():
        digest = blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8, key=b"second" if second else b"first").digest()
        out[k] = np.frombuffer(digest, "<u8")[0]
    return out


def sequence_hash(tokens: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive 64-bit tokens, mixed at each token."""
    count = max(0, len(tokens) - n + 1)
    out = np.full(count, np.uint64(n), np.uint64)
    for j in range(n):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + tokens[j : j + count])
    return out


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for each count, joined."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(starts - first, counts)
