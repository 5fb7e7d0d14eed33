"""Matroska media: texts stored as 8-bit PCM tracks, and stored bytes parsed into packet tables.

The reader handles variable-length EBML ids and sizes, unknown sizes, clusters with simple blocks and block groups, all
four lacings (none, Xiph, fixed, EBML) and cues. The writer makes files with fixed and EBML lacing and one cue a cluster.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from brindle.llm.common import map_rows

# Element ids, fixed by the format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, DEFAULT_DURATION = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0x23E383
AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}

RATE = 8000
UNIT = 64
FRAME = 512  # bytes, 64 ms
LACE = 8  # frames a block
BLOCKS = 16  # a cluster: 64 KiB, about 8 s, well inside the signed 16-bit block time


def vint(n: int, width: int | None = None) -> bytes:
    """An EBML size: the shortest width whose all-ones value (unknown) differs from ``n``."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return ((1 << 7 * width) | n).to_bytes(width, "big")


def element(eid: int, body: bytes) -> bytes:
    return eid.to_bytes((eid.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(eid: int, n: int) -> bytes:
    return element(eid, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _block(payload: bytes, start: int, stop: int, time: int) -> bytes:
    sizes = [min(FRAME, stop - at) for at in range(start, stop, FRAME)]
    if len(sizes) == 1:
        lacing, head = 0x00, b""
    elif sizes[0] == sizes[-1]:
        lacing, head = 0x04, bytes([len(sizes) - 1])
    else:  # EBML: the first size, then signed differences, the last size implied
        lacing, head = 0x06, bytes([len(sizes) - 1]) + vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
            head += vint(b - a + (1 << 7 * width - 1) - 1, width)
    return element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", time, 0x80 | lacing) + head + payload[start:stop])


def pad(data: bytes, unit: int = UNIT) -> bytes:
    """Bytes 0 up to a positive multiple of ``unit``."""
    return data + bytes(max(unit, -(-len(data) // unit) * unit) - len(data))


_HEADER = element(EBML, uint(0x4286, 1) + uint(0x42F7, 1) + uint(0x42F2, 4) + uint(0x42F3, 8) + element(0x4282, b"matroska") + uint(0x4287, 4) + uint(0x4285, 2))
_TRACKS = element(TRACKS, element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(FLAG_LACING, 1) + uint(DEFAULT_DURATION, FRAME * 10**9 // RATE) + element(CODEC_ID, b"A_PCM/INT/LIT") + element(AUDIO, element(SAMPLING, struct.pack(">f", RATE)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))))


def mux(payload: bytes) -> bytes:
    """A file with one 8 kHz mono track of unsigned 8-bit samples, the payload's bytes."""
    ms = len(payload) * 1000 // RATE
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", ms)) + element(MUXING_APP, b"brindle") + element(WRITING_APP, b"brindle"))
    parts, at, cues, span = [info, _TRACKS], len(info) + len(_TRACKS), [], FRAME * LACE * BLOCKS
    for start in range(0, len(payload), span):
        time, stop = start * 1000 // RATE, min(start + span, len(payload))
        body = uint(CLUSTER_TIME, time) + b"".join(_block(payload, b, min(b + FRAME * LACE, stop), b * 1000 // RATE - time) for b in range(start, stop, FRAME * LACE))
        cues.append(element(CUE_POINT, uint(CUE_TIME, time) + element(CUE_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        parts.append(element(CLUSTER, body))
        at += len(parts[-1])
    parts.append(element(CUES, b"".join(cues)))
    return _HEADER + element(SEGMENT, b"".join(parts))


def read_id(data: bytes, at: int) -> tuple[int, int]:
    width = 9 - data[at].bit_length()
    if width > 4 or at + width > len(data):
        raise ValueError(f"no element id at {at}")
    return int.from_bytes(data[at : at + width], "big"), at + width


def read_size(data: bytes, at: int) -> tuple[int | None, int]:
    """(size, next offset); the size is None where it is unknown (all ones)."""
    width = 9 - data[at].bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError(f"no element size at {at}")
    n = int.from_bytes(data[at : at + width], "big") & ((1 << 7 * width) - 1)
    return (None if n == (1 << 7 * width) - 1 else n), at + width


def children(data: bytes, at: int, stop: int, ends=frozenset()):
    """(id, start, body, end) of each element in a range. One of unknown size lasts until an id in ``ends`` or the end."""
    while at < stop:
        start = at
        eid, at = read_id(data, at)
        size, body = read_size(data, at)
        if size is None:
            end = body
            while end < stop:
                nid, n_at = read_id(data, end)
                if nid in (TOP if eid == CLUSTER else ends):
                    break
                n_size, n_body = read_size(data, n_at)
                end = stop if n_size is None else n_body + n_size
        else:
            end = body + size
        if end > stop:
            raise ValueError(f"element at {start} ends at {end}, beyond {stop}")
        yield eid, start, body, end
        at = end


def lace_sizes(data: bytes, at: int, stop: int, kind: int) -> tuple[list[int], int]:
    """Frame sizes of a block's payload and where the frames begin."""
    if kind == 0:
        return [stop - at], at
    n, at = data[at] + 1, at + 1
    if kind == 2:  # fixed
        if (stop - at) % n:
            raise ValueError("fixed lacing of uneven frames")
        return [(stop - at) // n] * n, at
    sizes: list[int] = []
    for k in range(n - 1):
        if kind == 1:  # Xiph: 255s and a rest
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:
            first = at
            raw, at = read_size(data, at)
            width = at - first
            raw = (1 << 7 * width) - 1 if raw is None else raw
            size = raw if k == 0 else sizes[-1] + raw - ((1 << 7 * width - 1) - 1)
        sizes.append(size)
    last = stop - at - sum(sizes)
    if min([last, *sizes]) < 0:
        raise ValueError("lacing runs beyond its block")
    return [*sizes, last], at


def parse(data: bytes) -> dict:
    """Tracks, packets, cues and the time scale of a file.

    packets: (track, time in ns, offset, size, keyframe, lace index, cluster offset); cues: (time in ns, track, absolute
    cluster offset). A file that ends inside an element raises ValueError.
    """
    out = {"tracks": {}, "packets": [], "cues": [], "scale": 1_000_000, "clusters": 0, "duration": None}
    top = list(children(data, 0, len(data)))
    if not top or top[0][0] != EBML:
        raise ValueError("no EBML header")
    for eid, _, seg, seg_end in top:
        if eid != SEGMENT:
            continue
        for kind, start, body, end in children(data, seg, seg_end, {EBML, SEGMENT}):
            if kind == INFO:
                for k, _, b, e in children(data, body, end):
                    if k == TIMESTAMP_SCALE:
                        out["scale"] = int.from_bytes(data[b:e], "big")
                    elif k == DURATION:
                        out["duration"] = struct.unpack(">d" if e - b == 8 else ">f", data[b:e])[0]
            elif kind == TRACKS:
                for k, _, b, e in children(data, body, end):
                    if k == TRACK_ENTRY:
                        found = {x: data[i:j] for x, _, i, j in children(data, b, e)}
                        number = int.from_bytes(found.get(TRACK_NUMBER, b""), "big")
                        out["tracks"][number] = (found.get(CODEC_ID, b"").decode(), int.from_bytes(found.get(TRACK_TYPE, b""), "big"), int.from_bytes(found.get(DEFAULT_DURATION, b""), "big"))
            elif kind == CLUSTER:
                out["clusters"] += 1
                _cluster(data, start, body, end, out)
            elif kind == CUES:
                for k, _, b, e in children(data, body, end):
                    if k == CUE_POINT:
                        time, where = 0, []
                        for x, _, i, j in children(data, b, e):
                            if x == CUE_TIME:
                                time = int.from_bytes(data[i:j], "big")
                            elif x == CUE_POSITIONS:
                                where.append({y: int.from_bytes(data[p:q], "big") for y, _, p, q in children(data, i, j)})
                        out["cues"] += [(time * out["scale"], w.get(CUE_TRACK, 0), seg + w.get(CUE_CLUSTER, 0)) for w in where]
    return out


def _cluster(data: bytes, start: int, body: int, end: int, out: dict) -> None:
    base = 0
    for k, _, b, e in children(data, body, end):
        if k == CLUSTER_TIME:
            base = int.from_bytes(data[b:e], "big")
        elif k in (SIMPLE_BLOCK, BLOCK_GROUP):
            group = {x: (i, j) for x, _, i, j in children(data, b, e)} if k == BLOCK_GROUP else {BLOCK: (b, e)}
            if BLOCK not in group:
                continue
            at, stop = group[BLOCK]
            track, at = read_size(data, at)
            time, flags = struct.unpack(">hB", data[at : at + 3])
            sizes, at = lace_sizes(data, at + 3, stop, flags >> 1 & 3)
            key = bool(flags & 0x80) if k == SIMPLE_BLOCK else REFERENCE not in group
            if BLOCK_DURATION in group:
                i, j = group[BLOCK_DURATION]
                step = int.from_bytes(data[i:j], "big") * out["scale"] // len(sizes)
            else:
                step = out["tracks"].get(track, ("", 0, 0))[2]
            for n, size in enumerate(sizes):
                out["packets"].append((track, (base + time) * out["scale"] + n * step, at, size, key, n, start))
                at += size


def read_back(data: bytes, track: int = 1) -> bytes:
    """The samples of one track, from its packets' byte ranges in time order."""
    return b"".join(data[at : at + size] for _, at, size in sorted((p[1], p[2], p[3]) for p in parse(data)["packets"] if p[0] == track))


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (binary) of every row: its whole text as UTF-8 (null: empty), padded and muxed. No shuffle."""

    def run(ids, texts):
        raw = [(t or "").encode() for t in texts]
        return {"doc_id": ids, "n_bytes": [len(r) for r in raw], "media": [mux(pad(r)) for r in raw]}

    return map_rows(docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text"), run, "doc_id bigint, n_bytes bigint, media binary", "doc_id", "text")


def packets(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """The packet table of stored files: one row a packet with its track, time, byte range, key flag, lace and cue.

    Null media have no packets; bytes that are no whole file give one row with ``error`` set and the rest null.
    """
    names = ("doc_id", "track", "time_ns", "offset", "size", "keyframe", "lace", "cluster_offset", "cued", "error")

    def run(ids, blobs):
        rows = []
        for i, data in zip(ids, blobs, strict=True):
            if data is None:
                continue
            try:
                found = parse(data)
            except (ValueError, IndexError, struct.error) as e:
                rows.append((i, *[None] * 8, str(e) or type(e).__name__))
                continue
            cued = {(c[1], c[2]) for c in found["cues"]}
            rows += [(i, *p, (p[0], p[6]) in cued, None) for p in found["packets"]]
        return {n: list(c) for n, c in zip(names, zip(*rows, strict=True) if rows else [[] for _ in names], strict=True)}

    return map_rows(media.selectExpr(f"`{id_col}` AS doc_id", f"`{media_col}` AS media"), run, "doc_id bigint, track bigint, time_ns bigint, offset bigint, size bigint, keyframe boolean, lace int, cluster_offset bigint, cued boolean, error string", "doc_id", "media")


def feature(data: bytes) -> tuple[bytes, str]:
    """(payload, feature string): counts of clusters, packets and cues, duration, and the samples' mean, deviation, entropy.

    Without samples these three are 0; a header without a duration counts as 0 ms. Bytes that are no whole file raise.
    """
    found = parse(data)
    rows = sorted((p[1], p[2], p[3]) for p in found["packets"] if p[0] == 1)
    payload = b"".join(data[at : at + size] for _, at, size in rows)
    hist = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    n, level = max(1, hist.sum()), np.arange(256)
    mean = float((hist * level).sum() / n)
    dev = float(np.sqrt((hist * (level - mean) ** 2).sum() / n))
    p = hist[hist > 0] / n
    starts = {p[6] for p in found["packets"]}
    text = f"clusters={found['clusters']};packets={len(rows)};cues={sum(c[2] in starts for c in found['cues'])};ms={found['duration'] or 0:.0f};mean={mean:.4f};dev={dev:.4f};entropy={abs(float((p * np.log2(p)).sum())):.4f}"
    return payload, text


def digest(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload and media digests and the feature of stored files, all from the stored bytes read back.

    One row for each row of ``media``, repeated ones too. Null media count as no bytes. No bytes, and bytes that are no whole
    file, have an empty payload, media digests as they are, and a feature of ``error=`` and the reason. Other columns are
    not read.
    """

    def read(data: bytes) -> tuple[bytes, str]:
        try:
            return feature(data)
        except (ValueError, IndexError, KeyError, TypeError, struct.error) as e:
            return b"", f"error={e or type(e).__name__}"

    def run(ids, n_bytes, blobs):
        stored = [d or b"" for d in blobs]
        found = [read(d) for d in stored]
        return {
            "doc_id": ids,
            "n_bytes": n_bytes,
            "payload_bytes": [len(p) for p, _ in found],
            "payload_sha256": [hashlib.sha256(p).hexdigest() for p, _ in found],
            "tail_crc32": [zlib.crc32(p[-UNIT:]) for p, _ in found],
            "media_bytes": [len(d) for d in stored],
            "media_sha256": [hashlib.sha256(d).hexdigest() for d in stored],
            "feature": [f for _, f in found],
        }

    return map_rows(media, run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string", "doc_id", "n_bytes", "media")
