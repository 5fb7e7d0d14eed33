"""Document fingerprints by locally consistent parsing.

A text's bytes are cut into phrases at places that only a few neighbouring symbols decide (deterministic coin tossing
reduces neighbours to labels below 6, and phrases begin at local maxima); a phrase's name is the hash of its content.
Names are parsed again into longer phrases, level by level. Equal substrings therefore have the same phrases at every
level but for a bounded margin at either end, wherever they stand. A fingerprint holds, for each level, the number of
phrases and a one-permutation min-hash of their names.
"""

from __future__ import annotations

import hashlib
import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from brindle.llm.common import mix64

LEVELS = 5
BINS = 64
#: A level speaks for two texts if both have this many phrases there; the highest such level is compared.
ENOUGH = 16
#: Bytes of text in one range of documents, about, and the most ranges there are; a range is one task, which reads it as a
#: stream, so a larger one costs time, not memory.
RANGE_BYTES, MOST_RANGES = 4 << 20, 65_536
#: Rows of the sample that sets the ranges' bounds, for each range.
SAMPLED = 8

_EMPTY = np.uint32(0xFFFFFFFF)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POWER = np.cumprod(np.full(64, 0xD1342543DE82EF95, np.uint64), dtype=np.uint64)


def _toss_table() -> np.ndarray:
    """label[previous << 8 | symbol]: twice the lowest differing bit's index, plus the symbol's bit there."""
    prev, sym = np.divmod(np.arange(1 << 16), 256)
    diff = prev ^ sym
    low = np.bitwise_count(((diff & -diff) - 1).astype(np.uint32)).astype(np.int64)
    return np.where(diff == 0, 0, 2 * low + (sym >> np.minimum(low, 7) & 1)).astype(np.uint8)


_TOSS = _toss_table()


def _toss(label: np.ndarray, first: np.ndarray) -> np.ndarray:
    pair = np.empty(len(label), np.uint16)
    pair[1:] = label[:-1]
    pair[first] = label[first] ^ 1  # a text's first symbol is compared to one made from it
    return _TOSS[(pair << np.uint16(8)) | label]


def _labels(sym: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 6; neighbours in a text have different ones, as their symbols have."""
    if sym.dtype == np.uint8:
        label = _toss(sym, first)
    else:
        prev = np.empty_like(sym)
        prev[1:] = sym[:-1]
        prev[first] = sym[first] ^ np.uint64(1)
        diff = prev ^ sym
        low = np.bitwise_count((diff & (~diff + np.uint64(1))) - np.uint64(1))
        label = (2 * low + ((sym >> low.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)).astype(np.uint8)
        label = _toss(label, first)
    return _toss(_toss(label, first), first)


def _level(sym: np.ndarray, value: np.ndarray | None, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of a level, and where each text's begin. first: where each text's symbols begin."""
    head = np.empty(len(sym), bool)
    head[0] = True
    np.not_equal(sym[1:], sym[:-1], out=head[1:])
    head[first] = True
    at = np.flatnonzero(head)  # a run of one symbol is one symbol with a length
    run = np.diff(at, append=len(sym)).astype(np.uint64)
    sym = sym[at]
    value = (_BYTE[sym] if value is None else sym) + run * np.uint64(0x9FB21C651E98DF25)
    first = np.searchsorted(at, first)
    label = _labels(sym, first)
    cut = np.zeros(len(sym), bool)
    if len(sym) > 2:
        np.logical_and(label[1:-1] > label[:-2], label[1:-1] > label[2:], out=cut[1:-1])
    cut[first[1:] - 1] = False  # a text's last symbol has no right neighbour
    cut[first] = True
    start = np.flatnonzero(cut)
    phrase = np.cumsum(cut) - 1
    offset = np.arange(len(sym)) - start[phrase]
    return mix64(np.add.reduceat(value * _POWER[np.minimum(offset, 63)], start)), phrase[first]


def sketches(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(counts, bins): for each text and level the number of phrases and the low 16 bits of BINS minima (all ones: empty)."""
    counts, bins = np.zeros((len(texts), LEVELS), np.int64), np.full((len(texts), LEVELS, BINS), _EMPTY, np.uint32)
    length = np.array([len(t) for t in texts], np.int64)
    owner = np.flatnonzero(length)
    if not len(owner):
        return counts, bins
    sym: np.ndarray = np.frombuffer(b"".join(texts), np.uint8)
    first = np.concatenate(([0], np.cumsum(length[owner])[:-1]))
    value = None
    for level in range(LEVELS):
        sym, first = _level(sym, value, first)
        value = sym
        counts[owner, level] = np.diff(first, append=len(sym))
        doc = np.repeat(owner, counts[owner, level])
        flat = np.full(len(texts) * BINS, _EMPTY, np.uint32)
        np.minimum.at(flat, doc * BINS + (sym >> np.uint64(58)).astype(np.int64), ((sym >> np.uint64(16)) & np.uint64(0xFFFFFFFE)).astype(np.uint32))
        bins[:, level] = np.where(flat == _EMPTY, _EMPTY, flat & np.uint32(0xFFFF)).reshape(len(texts), BINS)
    return counts, bins


def to_string(counts: np.ndarray, bins: np.ndarray) -> str:
    """``count:bins`` of each level, joined by ``;``: four hex digits a bin, ``----`` where it is empty."""
    parts = []
    for n, b in zip(counts.tolist(), bins, strict=True):
        digits = b.astype(">u2").tobytes().hex()
        if (b == _EMPTY).any():
            digits = "".join("----" if e else digits[4 * i : 4 * i + 4] for i, e in enumerate((b == _EMPTY).tolist()))
        parts.append(f"{n}:{digits}")
    return ";".join(parts)


def likeness(counts_a: np.ndarray, bins_a: np.ndarray, counts_b: np.ndarray, bins_b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of phrase sets, row by row, 0 to 1; two empty texts: 1."""
    level = np.zeros(len(counts_a), np.int64)
    for k in range(1, LEVELS):
        level[(counts_a[:, k] >= ENOUGH) & (counts_b[:, k] >= ENOUGH)] = k
    row = np.arange(len(level))
    a, b = bins_a[row, level], bins_b[row, level]
    used = (a != _EMPTY) | (b != _EMPTY)
    same = (a == b) & used
    return np.where(used.any(axis=1), same.sum(axis=1) / np.maximum(used.sum(axis=1), 1), 1.0)


def compare(one: str, other: str) -> float:
    """The likeness of two fingerprint strings."""

    def parse(s: str):
        rows = [p.split(":") for p in s.split(";")]
        words = [[0xFFFFFFFF if d == "----" else int(d, 16) for d in (b[i : i + 4] for i in range(0, 4 * BINS, 4))] for _, b in rows]
        return np.array([[int(n) for n, _ in rows]]), np.array([words], np.uint32)

    return float(likeness(*parse(one), *parse(other))[0])


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many first ones (or all) of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare_neighbours(it):
    """Arrow batches sorted by (range, copy, doc_id, hash) to results: each row with the one that follows it in its range."""
    kinds = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}
    schema = pa.schema([(n, kinds[k]) for n, k in map(str.split, SCHEMA.split(", "))])
    held: list[tuple] = []  # rows not yet given out: (range, copy, doc_id, text)
    size = 0

    def flush(rows):
        todo = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
        texts = [r[3] for r in rows]
        new = [edited(texts[i], texts[i + 1]).encode() for i in todo]
        counts, bins = sketches([t.encode() for t in texts])
        e_counts, e_bins = sketches(new)
        here, there = np.array(todo, np.int64), np.array(todo, np.int64) + 1
        near_edited = likeness(counts[here], bins[here], e_counts, e_bins)
        near_next = likeness(counts[here], bins[here], counts[there], bins[there])
        columns = ([rows[i][2] for i in todo], [len(texts[i]) for i in todo], [hashlib.sha256(t).hexdigest() for t in new], [to_string(counts[i], bins[i]) for i in todo], [to_string(c, b) for c, b in zip(e_counts, e_bins, strict=True)], near_edited, near_next)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for batch in it:
        for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            held.append(row)
            size += len(row[3])
            if len(held) > 1 and (len(held) > 512 or size > 1 << 20):
                yield flush(held)
                held, size = held[-1:], len(row[3])
    if len(held) > 1:
        yield flush(held)


def _bounds(rows: DataFrame) -> list[tuple]:
    """Lower (no id, doc_id, hash) keys of all ranges but the first, from a sample in which a row's chance follows its bytes.

    They only balance the ranges; results don't depend on them. The sample has at most about SAMPLED * MOST_RANGES rows of
    two numbers, whatever the table.
    """
    spark = rows.sparkSession
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    n = min(MOST_RANGES, max(4 * spark.sparkContext.defaultParallelism, -(-total // RANGE_BYTES)))
    chance = F.pmod(F.xxhash64("doc_id", "th", F.lit(8)), F.lit(1 << 30)) / float(1 << 30) * max(total, 1)
    # a row of many times the usual share stands for several
    picked = rows.filter(chance < F.col("bytes") * F.lit(float(SAMPLED * n))).select(F.col("doc_id").isNull().alias("none"), "doc_id", "th", F.greatest(F.lit(1), F.floor(F.col("bytes") * F.lit(float(SAMPLED * n)) / max(total, 1))).alias("w"))
    found = picked.toArrow().to_pydict()
    keys = sorted((not none, i or 0, th, w) for none, i, th, w in zip(*found.values(), strict=True))
    out, seen, step = [], 0.0, max(1.0, sum(k[3] for k in keys) / n)
    for k in keys:
        if seen >= step:
            out.append(k[:3])
            seen = 0.0
        seen += k[3]
    return sorted(set(out))


def _range_of(keys: list[tuple]) -> Column:
    """The number of bounds at or below a row's key, found in two steps: among every 128th bound, then among those between."""
    if not keys:
        return F.lit(0)
    make = lambda part: F.from_json(F.lit(json.dumps([{"a": bool(a), "b": b, "c": c} for a, b, c in part])), "array<struct<a:boolean,b:bigint,c:bigint>>")
    own = F.struct(F.col("doc_id").isNotNull().alias("a"), F.coalesce("doc_id", F.lit(0)).alias("b"), F.col("th").alias("c"))
    below = lambda bounds: F.size(F.filter(bounds, lambda x: x <= own))
    step = 128
    if len(keys) <= step:
        return below(make(keys))
    first = below(make(keys[::step]))
    parts = F.from_json(F.lit(json.dumps([[{"a": bool(a), "b": b, "c": c} for a, b, c in keys[i : i + step]] for i in range(0, len(keys), step)])), "array<array<struct<a:boolean,b:bigint,c:bigint>>>")
    return F.when(first == 0, 0).otherwise((first - 1) * step + below(F.element_at(parts, F.greatest(first, F.lit(1)))))


def _slots(spark, n: int) -> list[int]:
    """For each of n partitions an integer that ``repartition(n, integer)`` deals to it, so that every range is a task of its own."""
    tried = spark.range(int(n * (math.log(n + 1) + 12))).select(F.col("id").cast("int").alias("slot"))
    found = tried.groupBy(F.pmod(F.hash("slot"), F.lit(n)).alias("at")).agg(F.min("slot").alias("slot")).collect()
    slots = {r["at"]: r.slot for r in found}
    return [slots.get(i, i) for i in range(n)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every whole text and its edited text, and compare them and the next document's.

    Null texts are empty. Documents follow one another by ascending doc_id (nulls first, equal ids by the text's hash, then the
    text), the first after the last; a single document is its own successor. Repeated rows are documents of their own.

    Texts are shuffled once, to ranges of the order with about as many bytes each: rows of a range are sorted and read as a
    stream, and the first document of the following range is copied to its end. Bounds come from a sample, so neither
    gaps between ids nor equal or missing ids make a range large; only rows equal in both id and text stay together.
    """
    docs = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = docs.withColumn("th", F.xxhash64("text"))
    bounds = _bounds(rows.select("doc_id", "th", (F.octet_length("text") + 64).alias("bytes")))
    rows = rows.withColumn("range", _range_of(bounds).cast("int"))
    least = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "th"))
    heads = sorted((r.range, r.h) for r in rows.groupBy("range").agg(least.alias("h")).collect())  # one row a range
    spark = docs.sparkSession
    copies = [(h.doc_id, h.th, k, heads[i - 1][0]) for i, (k, h) in enumerate(heads)]
    first = F.broadcast(spark.createDataFrame(copies, "first_id bigint, first_th bigint, first_range int, before int"))
    here = F.struct("range", F.lit(False).alias("copy"))
    there = F.struct(F.col("before").alias("range"), F.lit(True).alias("copy"))
    is_first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("th") == F.col("first_th"))
    placed = rows.join(first, F.col("range") == F.col("first_range")).select(F.explode(F.when(is_first, F.array(here, there)).otherwise(F.array(here))).alias("at"), "doc_id", "th", "text")
    n = len(bounds) + 1
    slot = F.get(F.array(*map(F.lit, _slots(spark, n))) if n <= 128 else F.from_json(F.lit(json.dumps(_slots(spark, n))), "array<int>"), F.col("range"))
    placed = placed.select("at.range", "at.copy", "doc_id", "th", "text").withColumn("slot", slot).repartition(n, "slot")
    placed = placed.sortWithinPartitions("range", "copy", "doc_id", "th", "text").select("range", "copy", "doc_id", "text")
    return placed.mapInArrow(_compare_neighbours, StructType.fromDDL(SCHEMA))
