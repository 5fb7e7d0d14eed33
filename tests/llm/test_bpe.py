import base64
import hashlib
import random
import time

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from brindle.llm import bpe

RANKS, MERGES = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(7)
    out = ["", " ", "\n\n  x", "a" * 5000, "aaa", "The cat's 12345 café — ñandú 東京 \U0001f600‍!", "<|endoftext|>a<|endoftext|>", "x<|endoftext|> y", "\x1c\x1d\x85\xa0　 z", "-" * 700 + "=" * 701]
    for _ in range(300):
        kind = rng.randrange(4)
        n = rng.randrange(1, 60)
        pool = ["abcdefgh ", "the and ing tion er re 's 'll 've ", "".join(map(chr, range(32, 600))), "".join(map(chr, range(0x2000, 0x3100)))][kind]
        out.append("".join(rng.choice(pool) for _ in range(n)))
    out.append("".join(chr(c) for c in range(0xD800) if c))
    return out


def test_encode_equals_library_and_decodes(library):
    ts = texts()
    for t, got in zip(ts, bpe.encode(ts, RANKS, P.PATTERN), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library.encode_ordinary(t), t[:80]
        assert bpe.decode(got, RANKS) == t.encode()


def test_heap_and_matrix_agree():
    ranks = bpe.load_ranks(RANKS)
    rng = random.Random(3)
    pieces = [bytes(rng.choice(b"abett ingox") for _ in range(rng.randrange(2, 150))) for _ in range(300)] + [bytes(rng.choice(b"etaoinsh") for _ in range(n)) for n in (900, 1023, 1024, 1024)]
    pieces = [p for p in pieces if p not in ranks.ids]
    assert [np.frombuffer(x, "<u4").tolist() for x in ranks.encode_pieces(pieces)] == [ranks.by_heap(p) for p in pieces]


def test_count_equals_library():
    t = Tokenizer.from_file(MERGES)
    ts = texts()
    assert bpe.count(ts, MERGES, P.PATTERN) == [len(e.ids) for e in t.encode_batch(ts, add_special_tokens=False)]


def test_long_runs(library):
    rng = random.Random(11)
    runs = ["".join(rng.choice("etaoinshrdlu") for _ in range(80_000)), "ab" * 100_000, "z" * 300_001, "é" * 50_000]
    t = Tokenizer.from_file(MERGES)
    start = time.time()
    assert bpe.count(runs, MERGES, P.PATTERN) == [len(e.ids) for e in t.encode_batch(runs, add_special_tokens=False)]
    assert time.time() - start < 60
    for run, ids in zip(runs, bpe.encode(runs, RANKS, P.PATTERN), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(run)


def test_unreadable_ids(spark):
    rows = [(1, bytearray(b"\x00\x00\x00")), (2, bytearray(b"\xff" * 4)), (3, None), (None, bytearray())]
    got = {r.doc_id: r.decoded for r in bpe.decode_table(spark.createDataFrame(rows, "doc_id bigint, ids binary")).collect()}
    assert got == {1: None, 2: None, 3: b"", None: b""}


def test_tables(spark):
    rows = [(1, "a b"), (2, None), (None, ""), (1, "a b"), (3, "x<|endoftext|>")]
    docs = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id bigint, text string, ids string, n_tokens int")
    got = {(r.doc_id, r.n_tokens): r for r in bpe.round_trip_table(docs).collect()}
    assert got[(2, 0)].ids_sha256 == hashlib.sha256(b"").hexdigest() and len(bpe.round_trip_table(docs).collect()) == 5
    n = {(r.doc_id, r.n_bytes): (r.n_tokens, r.over_limit) for r in bpe.count_table(docs, limit=1).collect()}
    assert n == {(1, 3): (2, True), (2, 0): (0, False), (None, 0): (0, False), (3, 14): (2, True)}
    back = bpe.decode_table(bpe.encode_table(docs)).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded)) for r in back) == sorted((i or 0, (t or "").encode()) for i, t in rows)
    assert bpe.round_trip_table(docs.limit(0)).count() == 0
