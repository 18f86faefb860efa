"""op13 against tokenising and aligning each whole text in plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from public_tokenizers import path
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tabloom.llm import alignment
from tabloom.llm.alignment import align
from tabloom.llm.queries import op13_alignment

A, B = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


@pytest.fixture(scope="module")
def whole():
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    plain = [k for k in range(256) if 33 <= k < 127 or 161 <= k < 173 or 174 <= k]
    byte = {chr(k): k for k in plain} | {chr(256 + n): k for n, k in enumerate(k for k in range(256) if k not in plain)}

    def a_bytes(k):
        return bytes(byte[c] for c in a.id_to_token(k))

    def b_bytes(k):
        p = b.id_to_piece(k)
        return bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode()

    def spans(ids, of):
        at, out = 0, []
        for k in ids:
            out.append((k, at, at := at + len(of(k))))
        return out

    def one(text):
        """Groups and links of a text, None where there are no tokens."""
        if not text:
            return None
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        data = (" " + text).encode()
        if b"".join(map(a_bytes, x)) != data or b"".join(map(b_bytes, y)) != data:
            return None
        x, y = spans(x, a_bytes), spans(y, b_bytes)
        ends = sorted({e for *_, e in x} & {e for *_, e in y})
        groups, i, j = [], 0, 0
        for end in ends:
            left, right = [], []
            while i < len(x) and x[i][2] <= end:
                left.append(str(x[i][0]))
                i += 1
            while j < len(y) and y[j][2] <= end:
                right.append(str(y[j][0]))
                j += 1
            groups.append(",".join(left) + "|" + ",".join(right))
        links, first = [], 0
        for k, s, e in x:
            while y[first][2] <= s:
                first += 1
            j = first
            while j < len(y) and y[j][1] < e:
                links.append((k, y[j][0]))
                j += 1
        return len(x), len(y), groups, links

    return one


def brute(whole, docs):
    made = [(d, whole(t)) for d, t in docs]
    count = Counter(p for _, m in made if m for p in set(m[3]))
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    for d, m in made:
        if m is None:
            yield (d, 0, 0, 0, 0, 0, 0, None)
            continue
        best = sum(count[p] == most[p[0]] for p in m[3])
        yield d, m[0], m[1], len(m[2]), len(m[3]), best, sum(count[p] for p in m[3]), ";".join(m[2])


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", *COLUMNS, "groups").collect()), key=str)


def _texts(n, seed):
    rng = random.Random(seed)
    letters = ["a", "b", "the", "ing", "'s", " ", " ", "  ", "\n", "\t", "　", "\xa0", "\x1c", "\x85", "é", "漢", "1", "!", ";\r", "<s>", "<0x0A>", "<|endoftext|>", "\U0001f600", "\x00"]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_random_texts(spark, whole):
    docs = list(enumerate([*_texts(1_500, 1), None, "", " ", "   ", "▁ a", "a ▁b c", "x " * 2_000, "q" * 20_000, "end ", "end\n", "a▁", "same text", "same text"]))
    docs += [docs[5], docs[5]]
    table = spark.createDataFrame([(d, t, "clash", 3, None) for d, t in docs], "doc_id long, text string, groups string, n_a int, batch string").repartition(3)
    got = align(table, A, B)
    assert got.columns == ["doc_id", "batch", *COLUMNS, "groups"]
    assert rows(got) == sorted(brute(whole, docs), key=str)


def test_small_batches_and_chunks(spark, whole, monkeypatch):
    monkeypatch.setattr(alignment, "BATCH_BYTES", 500)
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 50)
    docs = list(enumerate(_texts(700, 2)))
    table = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    assert rows(align(table, A, B)) == sorted(brute(whole, docs), key=str)


def test_empty_table_and_text_only(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert align(empty, A, B).count() == 0
    only = align(spark.createDataFrame([("a b",)], "text string"), A, B)
    assert only.columns == [*COLUMNS, "groups"] and only.count() == 1


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, whole, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted(((*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] is not None else "") for r in brute(whole, docs)), key=str)
    assert rows(op13_alignment(spark, f"/root/testdata/{sf}").withColumnRenamed("groups_sha256", "groups")) == want
