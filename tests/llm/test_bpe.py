"""op11 against the tiktoken library, and edits against encoding anew."""

import base64
import hashlib
import random

import numpy as np
import pytest
import tiktoken
from public_tokenizers import PATTERN, path
from pyspark.sql import functions as F

from tabloom.llm.bpe import Encoder, Prefixes, decode, edit_encoded, encode, read_ranks
from tabloom.llm.queries import op11_bpe

RANKS = path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, ids string, decoded long, other double"


@pytest.fixture(scope="module")
def encoder():
    return Encoder(read_ranks(RANKS), PATTERN)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _ids(data):
    return np.frombuffer(data, "<u4").tolist()


def _texts(n, seed):
    rng = random.Random(seed)
    letters = "aabc'srelvdt  \n\t 　xyzéñ漢字1٣!?-\x1c\x85The tion ing"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_every_character_is_encoded_as_the_library_does(encoder, library):
    for code in [*range(0x3000), *range(0x3000, 0x110000, 61)]:
        if not 0xD800 <= code < 0xE000:
            text = f"a{chr(code)}b 1{chr(code)}2 !{chr(code)}! {chr(code)} "
            assert _ids(encoder.text(text)) == library.encode_ordinary(text), hex(code)


def test_random_texts_and_token_sequences(encoder, library):
    rng = random.Random(2)
    joined = [b"".join(rng.choices(encoder.merges.tokens, k=rng.randint(1, 6))).decode(errors="replace") for _ in range(3_000)]
    for text in [*_texts(5_000, 1), *joined, "", " ", "a" * 5_000, "<|endoftext|> <|im_start|>", "xy" * 3_000 + "\n" * 500]:
        assert _ids(encoder.text(text)) == library.encode_ordinary(text)


def test_own_ranks_with_ties_and_unreachable_tokens():
    # "abc" whole is a token, yet no merges lead to it: ab + c and a + bc are made of tokens of higher rank or of none.
    tokens = [b"a", b"b", b"c", b"aa", b"abc", b"ab", b"aaa", b"aaaa"]
    encoder = Encoder(tokens, r"\S+|\s+")
    own = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens={})
    rng = random.Random(4)
    for _ in range(2_000):
        text = "".join(rng.choices("aaab", k=rng.randint(1, 12)))
        assert _ids(encoder.text(text)) == own.encode_ordinary(text), text


def test_prefixes_append_and_replace(encoder):
    rng = random.Random(3)
    for _ in range(60):
        data = "".join(rng.choices(["the", "ing", "a", "tion", "é", "x"], k=60)).encode()
        prefixes = Prefixes(encoder.merges, data[:50])
        prefixes.append(data[50:])
        assert prefixes.last == Prefixes(encoder.merges, data).last
        at, removed, put = rng.randint(0, 40), rng.randint(0, 5), rng.choice([b"", b"q", b"ation"])
        seen = prefixes.replace(at, removed, put)
        assert seen <= len(prefixes.data) - at
        assert prefixes.last == Prefixes(encoder.merges, data[:at] + put + data[at + removed :]).last
    long = Prefixes(encoder.merges, b"thing" * 2_000)
    assert long.replace(100, 1, b"x") < 400


def test_edits_keep_the_ids_away_from_them(encoder):
    rng = random.Random(5)
    for old in _texts(1_500, 6):
        at, removed, put = rng.randint(0, len(old)), rng.randint(0, 6), rng.choice(["", " ", "s", "'s", "\n ", "  x"])
        new, ids = encoder.edit(old, encoder.text(old), at, removed, put)
        assert new == old[:at] + put + old[at + removed :]
        assert ids == encoder.text(new), (old, at, removed, put)


def test_edges_of_tables(spark, library):
    rows = [(1, None, "x", 5, 1.0), (2, "", "x", 5, 1.0), (3, "don't stop", "x", 5, None), (3, "don't stop", "x", 5, None), (4, "z" * 300_000, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = decode(encode(docs, RANKS, PATTERN), RANKS)
    assert got.columns == ["doc_id", "text", "other", "n_tokens", "ids", "decoded"]
    for row in got.collect():
        text = row.text or ""
        assert _ids(bytes(row.ids)) == library.encode_ordinary(text) and row.n_tokens == len(row.ids) // 4
        assert bytes(row.decoded).decode() == text
    assert got.count() == 5 and encode(docs.limit(0), RANKS, PATTERN).count() == 0


def test_edit_encoded(spark, library):
    docs = spark.createDataFrame([(1, "one two three", 1), (2, None, 2), (3, "it'", 3), (4, "same", 4)], "doc_id long, text string, more int")
    edits = spark.createDataFrame([(1, 4, 3, "x y"), (2, None, None, "new"), (3, None, None, "re"), (9, 0, 0, "q")], "doc_id long, at int, removed int, put string")
    got = {r.doc_id: r for r in edit_encoded(encode(docs, RANKS, PATTERN), edits, RANKS, PATTERN).collect()}
    assert {k: r.text for k, r in got.items()} == {1: "one x y three", 2: "new", 3: "it're", 4: "same"}
    for row in got.values():
        assert _ids(bytes(row.ids)) == library.encode_ordinary(row.text) and row.n_tokens == len(row.ids) // 4


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_the_library(spark, library, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", F.col("text")).collect()}
    rows = op11_bpe(spark, f"/root/testdata/{sf}").collect()
    assert len(rows) == len(docs)
    for row in rows:
        ids = library.encode_ordinary(docs[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(docs[row.doc_id].encode()).hexdigest()
