import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import matroska as m


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 140_000), st.integers(0, 255))
def test_round_trip(n, seed):
    payload = m.pad(bytes((i * 31 + seed) % 251 for i in range(n)))
    data = m.mux(payload)
    assert m.read_back(data) == payload
    found = m.parse(data)
    clusters = {p[6] for p in found["packets"]}
    assert {c[2] for c in found["cues"]} == clusters and len(clusters) == found["clusters"]
    assert sorted(p[1] for p in found["packets"]) == [64_000_000 * i for i in range(len(found["packets"]))]


def _file(blocks: bytes, unknown: bool) -> bytes:
    size = b"\x01" + b"\xff" * 7 if unknown else None
    wrap = lambda eid, body: eid.to_bytes(4, "big") + (size or m.vint(len(body))) + body
    return m._HEADER + wrap(m.SEGMENT, m._TRACKS + wrap(m.CLUSTER, m.uint(m.CLUSTER_TIME, 5) + blocks) + wrap(m.CLUSTER, m.uint(m.CLUSTER_TIME, 900) + blocks))


@pytest.mark.parametrize("unknown", [False, True])
def test_every_lacing_and_unknown_sizes(unknown):
    xiph = m.element(m.SIMPLE_BLOCK, b"\x81\x00\x00\x82" + bytes([2, 255, 45, 2]) + b"a" * 300 + b"bb" + b"c" * 7)
    ebml = m.element(m.SIMPLE_BLOCK, b"\x81\x00\x09\x06" + bytes([2]) + m.vint(200) + (3 - 200 + (1 << 13) - 1 | 1 << 14).to_bytes(2, "big") + b"d" * 200 + b"eee" + b"f")
    group = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, b"\x81\xff\xff\x04\x01" + b"gghh") + m.uint(m.BLOCK_DURATION, 10) + m.element(m.REFERENCE, b"\xff"))
    got = m.parse(_file(m.element(0xEC, b"xx") + xiph + ebml + group, unknown))
    assert [p[3] for p in got["packets"]] == [300, 2, 7, 200, 3, 1, 2, 2] * 2
    assert [p[4] for p in got["packets"]][:8] == [True] * 3 + [False] * 5
    assert got["packets"][6][1] == 4_000_000 and got["packets"][7][1] == 9_000_000 and got["packets"][8][1] == 900_000_000
    data = _file(xiph + ebml + group, unknown)
    assert m.read_back(data).count(b"a") == 600


def test_tables(spark):
    rows = [(1, "é" * 3000), (2, None), (2, ""), (None, "x"), (1, "é" * 3000)]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id bigint, text string, media int")
    got = m.digest(m.store(docs)).collect()
    for r in got:
        raw = {1: ("é" * 3000).encode(), 2: b"", None: b"x"}[r.doc_id]
        payload = raw + bytes(-len(raw) % 64 or (64 if not raw else 0))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.media_bytes > r.payload_bytes
    table = m.packets(m.store(docs)).collect()
    assert len([r for r in table if r.doc_id == 1]) == 2 * -(-6016 // 512) and all(r.cued for r in table)
    bad = spark.createDataFrame([(1, b"junk"), (2, None), (3, m.mux(bytes(64))[:-9])], "doc_id bigint, media binary")
    assert sorted((r.doc_id, r.error is not None) for r in m.packets(bad).collect()) == [(1, True), (3, True)]
    assert m.digest(m.store(docs.limit(0))).count() == 0


def test_digest_of_null_corrupt_and_empty_media(spark):
    header = m.mux(m.pad(b"x"))[:60]
    rows = [(1, 3, m.mux(m.pad(b"abc"))), (2, None, None), (3, 0, bytearray()), (4, 1, bytearray(b"\x1a\x45")), (5, 1, bytearray(header)), (1, 3, m.mux(m.pad(b"abc")))]
    got = [r.asDict() for r in m.digest(spark.createDataFrame([(*r, 0, "f") for r in rows], "doc_id bigint, n_bytes bigint, media binary, media_bytes int, feature string")).collect()]
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 6 and by[1]["payload_sha256"] == hashlib.sha256(m.pad(b"abc")).hexdigest()
    empty = hashlib.sha256(b"").hexdigest()
    for i in (2, 3, 4, 5):
        assert by[i]["payload_bytes"] == 0 and by[i]["payload_sha256"] == empty and by[i]["tail_crc32"] == 0
    assert by[2]["media_bytes"] == 0 and by[4]["media_bytes"] == 2 and by[4]["feature"].startswith("error=")
