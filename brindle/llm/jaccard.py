"""N-gram Jaccard join: candidates by a partition of the shingle universe, verified exactly.

Documents of a size band share one partition of the universe into segments. Two sets that are similar enough differ in
at most H shingles, so if segments with allowances v (1: equal; 2: at most one shingle differs) have a sum above H,
some segment stays within its allowance. Each document indexes the hash of its part of every segment, and for segments
of allowance 2 also of the part with each one shingle left out. How many segments get allowance 2, and how many of a
document's least telling parts are left out, is decided for each band by the estimated cost of index rows and
candidates. The estimate uses what the pass over all documents measures: which shingles many documents share, and how
much unrelated documents overlap in the others.

Documents with equal hashes form buckets. Buckets are reduced to stars within tasks and again after the shuffle; star
edges are verified on whole sets; what a star leaves undecided in buckets of three or more is verified in blocks of
documents of similar size, so no bucket is ever expanded into its pairs and no link is lost. Before texts are fetched,
parity bitmaps of the sets, a few bits a shingle, bound their symmetric difference from below and rule most pairs out.
Sets are compared by 64-bit hashes of their shingles.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from brindle.llm.common import map_rows, materialise, mix64, release, slices
from brindle.llm.components import connected
from brindle.llm.shingles import shingle_sets

#: Upper over lower size of a band.
RATIO = 1.3
#: The cost of a candidate in index rows, as measured: about 100 µs for an edge that is looked up and ruled out or verified,
#: 2.5 µs for an index row that is made, shuffled and sorted.
CANDIDATE_COST = 40
#: Shingles that are looked at together for the statistics, the least share of their documents that makes a shingle common,
#: the documents among them that are compared with all others, and how many common shingles are remembered. The latter
#: only rank a document's parts; no result depends on them.
CHUNK_SHINGLES, COMMON_SHARE, PROBES, COMMON_KEPT = 1_000_000, 0.002, 32, 1 << 18
#: (hash, document) rows that a task gathers before it reduces them to stars.
GATHERED = 400_000
#: Shingles and documents of a verification block.
BLOCK_SHINGLES, BLOCK_ROWS = 250_000, 512
#: Up to so many rows of (text hash, id) are broadcast to fetch texts; beyond, they are joined by shuffle.
BROADCAST_ROWS = 400_000


@dataclass(frozen=True)
class Threshold:
    """Similar: den * intersection >= num * union."""

    num: int
    den: int

    def most_apart(self, size: int) -> int:
        """H: the largest symmetric difference of two similar sets whose smaller one has ``size`` shingles."""
        return (self.den - self.num) * (size + size * self.den // self.num) // (self.den + self.num)

    def smallest(self, size: int) -> int:
        """The smallest set that may be similar to one of ``size``."""
        return -(-size * self.num // self.den)


    def apart(self, a, b):
        """The largest symmetric difference of two similar sets of these sizes."""
        return (self.den - self.num) * (a + b) // (self.den + self.num)


@dataclass(frozen=True)
class Band:
    """Segments of allowance 2 (deleting) come before those of allowance 1 (exact). skip: how many of a document's least
    telling exact parts (or deleting ones, where there are no exact ones) are not indexed; spare: the allowance that may
    fall on deleting parts of at most one shingle."""

    low: int
    high: int  # exclusive
    exact: int
    deleting: int
    skip: int
    spare: int

    @property
    def segments(self) -> int:
        return self.exact + self.deleting


def bounds(most: int, t: Threshold) -> list[int]:
    """Lower sizes of the bands; sizes below the first allow no difference at all, so only equal sets are similar there."""
    low = next(n for n in range(1, 10 * t.den) if t.most_apart(n) > 0)
    out = [low]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, int(out[-1] * RATIO)))
    return out


def _poisson(mean: float) -> np.ndarray:
    k = np.arange(int(mean + 10 * math.sqrt(mean + 1)) + 2)
    return np.exp(k * math.log(mean) - mean - np.array([math.lgamma(x + 1) for x in k]))


@dataclass(frozen=True)
class Overlap:
    """What unrelated documents share. pairs: (part of a document's rarer shingles that another one has, share of all pairs
    of documents with that); common: the share of shingles that many documents have."""

    pairs: tuple[tuple[float, float], ...] = ((0.05, 1.0),)
    common: float = 0.0


def allocate(low: int, high: int, documents: int, t: Threshold, overlap: Overlap = Overlap()) -> Band:
    """The cheapest allocation for a band: how many segments get allowance 2, and how many of a document's least telling
    parts it leaves out. Costs are index rows and the candidates expected of the band's ``documents``; a bucket is reduced
    to a star, so an index row makes one candidate at most.
    """
    h, size = t.most_apart(high - 1), (low + high) / 2
    shares = sorted({0, *(math.ceil(h * f) for f in (0.05, 0.1, 0.15, 0.2, 0.3, 0.45))})
    options = [(h + 1 + skip + 2 * (d > 0) - 2 * d, d, skip, 2 * (d > 0)) for d in sorted({0, *(round(h * f) for f in (0.1, 0.25, 0.5)), *range(min(h, 4) + 1)}) for skip in shares if skip or d]
    options = [o for o in options if o[0] >= max(o[2], 1)] + [(0, h // 2 + 2 * skip + 1, skip, 0) for skip in shares]
    best = None
    for e, d, skip, spare in options:
        mean = size / (d + e)
        p = _poisson(max(mean * (1 - overlap.common), 1e-3))
        k = np.arange(len(p))
        equal = sum(share * o**k for o, share in overlap.pairs)
        near = np.minimum(1, sum(share * (2 * k + 1) * o ** np.maximum(k - 1, 0) for o, share in overlap.pairs))
        least = lambda n: np.minimum(p, np.maximum(0, np.cumsum(p) - (skip / n)))  # noqa: B023, E731 (the least telling parts go first)
        met = lambda chance: 1 - np.exp(-documents * np.minimum(1, chance))
        if e:
            rows, found = e - skip + d * (1 + mean), (e * least(e) * met(equal)).sum() + d * (p * (1 + k) * met(near)).sum()
        else:
            rows, found = (d - skip) * (1 + mean), (d * least(d) * (1 + k) * met(near)).sum()
        cost = rows + CANDIDATE_COST * found
        if best is None or cost < best[0]:
            best = (cost, Band(low, high, e, d, skip, spare))
    return best[1]


def signatures(s: np.ndarray, number: int, band: Band, common: np.ndarray | None = None) -> np.ndarray:
    """Index hashes of one set in one band: of each segment's part, and with one shingle left out where that is allowed.

    A part tells the less the fewer shingles it has that are not common (sorted hashes), then the fewer it has at all; both
    follow from the part alone. With exact segments two similar sets agree on segments with allowances of at least
    1 + skip + spare. The exact ones among these have equal parts, so both sets rank them alike; the first ``skip`` of a
    set's ranking can't hold them all. Without, at least 1 + 2 * skip segments differ by one shingle at most, and what two
    sets leave out, however they rank, can't hold them all.
    """
    m, d = band.segments, band.deleting
    mixed = mix64(s + np.uint64((number + 1) * 0x9E3779B97F4A7C15 % 2**64))
    segment = ((mixed >> np.uint64(33)) % np.uint64(m)).astype(np.int64)
    part = np.zeros(m, np.uint64)
    np.add.at(part, segment, mixed)
    size = np.bincount(segment, minlength=m)
    rare = size
    if common is not None and len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        rare = np.bincount(segment[common[at] != s], minlength=m)
    label = mix64(np.arange(m, dtype=np.uint64) + (np.uint64(number + 1) << np.uint64(32)))
    if not band.exact:
        kept = np.zeros(m, bool)
        kept[np.lexsort((size, rare))[band.skip :]] = True
        cut = kept[segment]
        return mix64(np.concatenate([part[kept] + label[kept], part[segment[cut]] - mixed[cut] + label[segment[cut]]]))
    exact = d + np.lexsort((size[d:], rare[d:]))[band.skip :]
    out = [part[exact] + label[exact]]
    if d:
        cut = segment < d
        whole, less = part[:d] + label[:d], part[segment[cut]] - mixed[cut] + label[segment[cut]]
        if 2 * int((size[:d] <= 1).sum()) <= band.spare:  # what is nearly empty may be left out
            whole, less = whole[size[:d] > 0], less[size[segment[cut]] > 1]
        out += [whole, less]
    return mix64(np.concatenate(out))


def bitmap(s: np.ndarray) -> bytes:
    """Parities of the set's shingles in at least twice as many bits, a power of two."""
    bits = max(64, 1 << (2 * len(s) - 1).bit_length())
    at = (mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def fold(b: bytes, size: int) -> np.ndarray:
    """A bitmap with ``size`` bytes, as 64-bit words: the parities of the same set in fewer bits."""
    return np.bitwise_xor.reduce(np.frombuffer(b, np.uint64).reshape(-1, size // 8), axis=0)


def node_of(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit hashes of a set; the first names it."""
    if not len(s):
        return 0, 0
    a = mix64(np.array([s.sum(dtype=np.uint64) + np.uint64(len(s)), mix64(s).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)
    return int(a[0]), int(a[1])


def _sets(texts: list[str | None], width: int, seed: int) -> list[np.ndarray]:
    return shingle_sets([(t or "").encode() for t in texts], width, seed)


_SETS = "doc_id bigint, th bigint, n bigint, node bigint, proof bigint, bits binary, kind int, x bigint, y bigint"


def set_table(docs: DataFrame, width: int, seed: int = 0) -> DataFrame:
    """doc_id, th (hash of the text), n, node, proof, bits (bitmap) of every row, kind 0. Rows with equal sets have equal nodes;
    n = 0 links with nothing. Further rows hold x and y only: a common shingle and its documents (kind 1), a tenth of an
    overlap below 0.5 and its pairs (2), all pairs (3), occurrences of common shingles and of all (4)."""
    schema = StructType.fromDDL(_SETS)
    arrow = to_arrow_schema(schema)

    def facts(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
        none = pa.nulls(len(rows), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, none, none, pa.nulls(len(rows), pa.binary()), *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(arrow)[6:], strict=True))], schema=arrow)

    def run(it):
        held: dict[int, np.ndarray] = {}
        size = 0
        for batch in it:
            for start, stop in slices(batch, ("text",), 256, 1 << 20):
                part = batch.slice(start, stop - start)
                sets = _sets(part.column(2).to_pylist(), width, seed)
                nodes = [node_of(s) for s in sets]
                zero = pa.array(np.zeros(len(sets), np.int32))
                none = pa.nulls(len(sets), pa.int64())
                columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array([a for a, _ in nodes], pa.int64()), pa.array([b for _, b in nodes], pa.int64()), pa.array([bitmap(s) if len(s) else None for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns, zero, none, none], schema=arrow)
                for (node, _), s in zip(nodes, sets, strict=True):
                    if len(s) and node not in held:
                        held[node] = s
                        size += len(s)
                if size > CHUNK_SHINGLES:
                    yield facts(chunk_facts(list(held.values())))
                    held, size = {}, 0
        if len(held) > 1:
            yield facts(chunk_facts(list(held.values())))

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    return rows.mapInArrow(run, schema)


def chunk_facts(sets: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """(kind, x, y) rows of some different sets, as ``set_table`` gives them."""
    token, inverse, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = df >= max(4, math.ceil(COMMON_SHARE * len(sets)))
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    holders, first = owner[np.argsort(inverse, kind="stable")], np.cumsum(df) - df
    ends = np.cumsum([len(s) for s in sets])
    hist, pairs = np.zeros(5, np.int64), 0
    for i in range(0, len(sets), max(1, len(sets) // PROBES)):
        own = inverse[ends[i] - len(sets[i]) : ends[i]]
        own = own[~common[own]]
        pairs += len(sets) - 1
        if len(own):
            at = np.repeat(first[own] - np.cumsum(df[own]) + df[own], df[own]) + np.arange(df[own].sum())
            shared = np.bincount(holders[at], minlength=len(sets))
            shared[i] = 0
            part = shared[shared > 0] / len(own)
            hist += np.bincount((part[part < 0.5] * 10).astype(np.int64), minlength=5)
    out = [(1, x, y) for x, y in zip(token[common].view(np.int64).tolist(), df[common].tolist(), strict=True)]
    return [*out, *((2, i, int(n)) for i, n in enumerate(hist)), (3, 0, pairs), (4, int(df[common].sum()), int(df.sum()))]


def measured(facts: DataFrame) -> tuple[np.ndarray, Overlap]:
    """(sorted common shingles, overlap) of all chunks' rows; of very many common shingles the most frequent."""
    common = facts.filter("kind = 1").groupBy("x").agg(F.sum("y").alias("y")).orderBy(F.desc("y"), "x").limit(COMMON_KEPT).select("x").toArrow()
    rows = {(r.kind, r.x if r.kind == 2 else 0): (r.s, r.y) for r in facts.filter("kind > 1").groupBy("kind", F.when(F.col("kind") == 2, F.col("x")).otherwise(0).alias("x")).agg(F.sum(F.col("x")).alias("s"), F.sum("y").alias("y")).collect()}
    pairs = max(1, rows.get((3, 0), (0, 0))[1])
    part, whole = rows.get((4, 0), (0, 0))
    found = tuple(((i + 0.5) / 10, rows[2, i][1] / pairs) for i in range(5) if rows.get((2, i), (0, 0))[1])
    return np.sort(common.column(0).to_numpy().view(np.uint64)), Overlap(found, part / max(1, whole))


_INDEX = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _local_stars(key: np.ndarray, node: np.ndarray):
    """(key, a, b) rows of gathered (key, node) rows: for each key its smallest node (b null, or a where others follow it),
    and the edges from that node to the others."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    key, node = key[fresh], node[fresh]
    start = np.ones(len(key), bool)
    start[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(start)
    rep = node[at][np.cumsum(start) - 1]
    edges = np.unique(np.stack([rep[~start], node[~start]], axis=1), axis=0)
    several = np.diff(at, append=len(key)) > 1
    head = node[at]
    nulls = np.concatenate([~several, np.zeros(len(edges), bool)])
    a = np.concatenate([head, edges[:, 0]])
    b = np.concatenate([head, edges[:, 1]])
    k = np.concatenate([key[at], mix64(edges[:, 1].view(np.uint64)).view(np.int64)])
    for i in range(0, len(a), 100_000):
        cut = slice(i, i + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(k[cut]), pa.array(a[cut]), pa.array(b[cut], mask=nulls[cut])], schema=_INDEX)


def _index(width: int, seed: int, t: Threshold, plan: list[Band], common: np.ndarray):
    lows = [b.low for b in plan]

    def run(it):
        keys, nodes, n, seen = [], [], 0, set()
        for batch in it:
            for start, stop in slices(batch, ("text",), 256, 1 << 20):
                for s in _sets(batch.column(0).slice(start, stop - start).to_pylist(), width, seed):
                    node = node_of(s)[0]
                    if not lows or len(s) < lows[0] or node in seen:
                        continue
                    if len(seen) < 1_000_000:
                        seen.add(node)
                    own = int(np.searchsorted(lows, len(s), side="right")) - 1
                    for number in range(own, -1, -1):
                        if number < own and plan[number].high <= t.smallest(len(s)):
                            break
                        sig = signatures(s, number, plan[number], common)
                        keys.append(sig.view(np.int64))
                        nodes.append(np.full(len(sig), node, np.int64))
                        n += len(sig)
                if n > GATHERED:
                    yield from _local_stars(np.concatenate(keys), np.concatenate(nodes))
                    keys, nodes, n = [], [], 0
        if n:
            yield from _local_stars(np.concatenate(keys), np.concatenate(nodes))

    return run


def _stars(it):
    """Edges (a, b, big) from index rows sorted by key and a. big: the bucket has three documents or more, so its star does
    not decide all of its pairs. A bucket that crosses batches carries only its first two documents on."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("big", pa.bool_())])

    def give(a, b, big):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(big, pa.bool_())], schema=schema)

    carry: list[tuple[int, int, bool]] = []  # (key, node, several) of the last bucket
    for batch in it:
        key, a = (batch.column(i).to_numpy() for i in (0, 1))
        b_null = batch.column(2).is_null().to_numpy(zero_copy_only=False)
        b = batch.column(2).fill_null(0).to_numpy()
        edge = ~b_null & (b != a)
        if edge.any():
            yield give(a[edge], b[edge], np.ones(edge.sum(), bool))
        key, a, several = key[~edge], a[~edge], ~b_null[~edge]
        if not len(key):
            continue
        if carry:
            key = np.concatenate([[c[0] for c in carry], key])
            a = np.concatenate([[c[1] for c in carry], a])
            several = np.concatenate([[c[2] for c in carry], several])
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        bucket = np.cumsum(first) - 1
        at = np.flatnonzero(first)
        new = np.ones(len(key), bool)
        new[1:] = first[1:] | (a[1:] != a[:-1])
        size = np.add.reduceat(new.astype(np.int64), at)
        big = (size > 2) | np.logical_or.reduceat(several, at)
        rep = a[at][bucket]
        out = new & ~first
        last = bucket == bucket[-1]
        tail = np.flatnonzero(last & new)[:2]
        carry = [(int(key[i]), int(a[i]), bool(big[-1])) for i in tail]
        if len(tail) == 2:
            out[tail[1]] = False  # given out when the bucket ends
        if out.any():
            yield give(rep[out], a[out], big[bucket[out]])
    if len(carry) == 2:
        yield give([carry[0][1]], [carry[1][1]], [carry[0][2]])


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    i = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int((y[i] == x).sum())


def _fetch(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, text: one text for each of ``nodes`` (column node), from the class's first row."""
    need = classes.join(nodes, "node", "left_semi").select("node", F.col("first.th").alias("th"), F.col("first.doc_id").alias("__id"))
    need = materialise(need, "need")
    rows = docs.select("doc_id", "text").withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    side = F.broadcast(need) if need.count() <= BROADCAST_ROWS else need
    found = rows.join(side, (rows["th"] == side["th"]) & rows["doc_id"].eqNullSafe(side["__id"])).select("node", F.coalesce("text", F.lit("")).alias("text"))
    return found.dropDuplicates(["node"])


def _possible(edges: DataFrame, classes: DataFrame, t: Threshold) -> DataFrame:
    """a, b, big, possible: whether sizes and bitmaps leave it open that an edge is a link."""

    def run(a, b, big, n_a, n_b, bits_a, bits_b):
        out = []
        for x, y, p, q in zip(n_a, n_b, bits_a, bits_b, strict=True):
            open_ = min(x, y) >= t.smallest(max(x, y))
            if open_:
                size = min(len(p), len(q))
                open_ = int(np.bitwise_count(fold(p, size) ^ fold(q, size)).sum()) <= t.apart(x, y)
            out.append(open_)
        return {"a": a, "b": b, "big": big, "possible": out}

    side = lambda c: classes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    return map_rows(edges.join(side("a"), "a").join(side("b"), "b"), run, "a bigint, b bigint, big boolean, possible boolean", "a", "b", "big", "n_a", "n_b", "bits_a", "bits_b")


def _verify(edges: DataFrame, texts: DataFrame, width: int, seed: int, t: Threshold) -> DataFrame:
    """a, b of the edges that are links, decided on the whole sets of their two texts."""

    def run(a, b, text_a, text_b):
        named = dict(zip(a + b, text_a + text_b, strict=True))
        sets = dict(zip(named, _sets(list(named.values()), width, seed), strict=True))
        links = []
        for x, y in zip(a, b, strict=True):
            i = _overlap(sets[x], sets[y])
            if t.den * i >= t.num * (len(sets[x]) + len(sets[y]) - i):
                links.append((x, y))
        return {"a": [x for x, _ in links], "b": [y for _, y in links]}

    rows = edges.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return map_rows(rows, run, "a bigint, b bigint", "a", "b", "text_a", "text_b", rows=256, size=2 << 20)


def _block_open(pdf, t: Threshold):
    """The documents of a block or of two that sizes and bitmaps leave as possible links between components."""
    if pdf.comp.nunique() > 1:
        n, comp = pdf.n.to_numpy(), pdf.comp.to_numpy()
        size = min(map(len, pdf.bits))
        words = np.stack([fold(b, size) for b in pdf.bits])
        found = np.zeros(len(pdf), bool)
        for i in range(len(pdf) - 1):
            rest = slice(i + 1, None)
            near = (np.bitwise_count(words[rest] ^ words[i]).sum(axis=1) <= t.apart(n[rest], n[i])) & (comp[rest] != comp[i])
            found[rest] |= near
            found[i] |= near.any()
        pdf = pdf[found]
    else:
        pdf = pdf[:0]
    return pdf[["cluster", "c", "kind", "x", "y", "node", "comp"]]


def _block_links(pdf, width: int, seed: int, t: Threshold):
    """Links that join different components among the documents of a block or of two."""
    import pandas as pd

    out: list[tuple[int, int]] = []
    if pdf.comp.nunique() > 1:
        pdf = pdf.sort_values("node")
        sets = _sets(pdf.text.tolist(), width, seed)
        size = np.array([len(s) for s in sets])
        token, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), size)
        shared = times[inverse] > 1
        column = (np.cumsum(times > 1) - 1)[inverse[shared]]
        row, width_ = owner[shared], int((times > 1).sum())
        both = np.zeros((len(sets), len(sets)), np.float32)
        for low in range(0, width_, 16_384):
            here = (column >= low) & (column < low + 16_384)
            x = np.zeros((len(sets), min(16_384, width_ - low)), np.float32)
            x[row[here], column[here] - low] = 1
            both += x @ x.T
        both = both.astype(np.int64)
        i, j = np.nonzero(np.triu(t.den * both >= t.num * (size[:, None] + size[None, :] - both), 1))
        comp, node = pdf.comp.tolist(), pdf.node.tolist()
        up: dict[int, int] = {}

        def root(c):
            while c in up:
                c = up[c]
            return c

        for p, q in zip(i.tolist(), j.tolist(), strict=True):
            x, y = root(comp[p]), root(comp[q])
            if x != y:
                up[max(x, y)] = min(x, y)
                out.append((node[p], node[q]))
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def _decide_rest(docs: DataFrame, clusters: DataFrame, comps: DataFrame, classes: DataFrame, width: int, seed: int, t: Threshold) -> DataFrame | None:
    """Links between components within a cluster of buckets, found block by block; None if there is nothing to decide.

    A cluster's documents are dealt by size class and hash into blocks of bounded size, and every two blocks of the same or
    of neighbouring classes meet in one group, first with their bitmaps; texts are fetched for the documents that these
    leave open. Size classes are as wide as similar sets may differ.
    """
    members = clusters.withColumnRenamed("comp", "cluster").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    members = materialise(members, "members")
    open_ = members.groupBy("cluster").agg(F.count("*").alias("k"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("k > 2 AND lo <> hi").select("cluster")
    open_ = _small(materialise(open_, "undecided"))
    base = math.log(t.den / t.num * 1.0001)
    rows = members.join(open_, "cluster", "left_semi").join(classes.select("node", "n", "bits"), "node").withColumn("c", F.floor(F.log("n") / base))
    rows = materialise(rows, "open")
    release(members)
    if rows.isEmpty():
        return None
    parts = rows.groupBy("cluster", "c").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_ROWS)).cast("int").alias("parts"))
    parts = _small(materialise(parts, "parts"))
    for step, name in ((0, "own"), (1, "above"), (-1, "below")):
        rows = rows.join(parts.select("cluster", (F.col("c") - step).alias("c"), F.col("parts").alias(name)), ["cluster", "c"], "left")
    h = F.pmod(F.xxhash64("node"), F.col("own"))
    none = F.expr("array()").cast("array<struct<c:bigint,kind:int,x:bigint,y:bigint>>")

    def pairs(count, make):
        return F.when(F.col(count) > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), F.col(count).cast("bigint") - 1), make)).otherwise(none)

    def meet(c, kind, x, y):
        return F.struct(c.cast("bigint").alias("c"), F.lit(kind).alias("kind"), x.cast("bigint").alias("x"), y.cast("bigint").alias("y"))

    groups = F.concat(
        pairs("own", lambda o: meet(F.col("c"), 0, F.least(h, o), F.greatest(h, o))),
        pairs("above", lambda o: meet(F.col("c"), 1, h, o)),
        pairs("below", lambda o: meet(F.col("c") - 1, 1, o, h)),
    )
    meeting = ["cluster", "c", "kind", "x", "y"]
    dealt = rows.select("cluster", "node", "comp", "n", "bits", F.explode(groups).alias("at")).select("cluster", "at.*", "node", "comp", "n", "bits")
    left = dealt.groupBy(*meeting).applyInPandas(lambda pdf: _block_open(pdf, t), "cluster bigint, c bigint, kind int, x bigint, y bigint, node bigint, comp bigint")
    left = materialise(left, "left")
    release(rows)
    if left.isEmpty():
        return None
    texts = _fetch(docs, classes, left.select("node").distinct())
    return left.join(texts, "node").groupBy(*meeting).applyInPandas(lambda pdf: _block_links(pdf, width, seed, t), "a bigint, b bigint")


def groups(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, th, n_shingles, component_id, keep: one row for each row of ``docs`` (columns doc_id, text; others are not read).

    A document's set holds its distinct shingles of ``width`` words (A-Z lower-cased); a shorter text is one shingle of all
    its words; null, empty and blank texts have none and link with nothing. Two rows link when den * intersection >=
    num * union; component_id is the smallest doc_id reachable by links, null only where all of these are null. keep marks
    the first row of each component by (doc_id, text hash) and every row without words; equal rows are all marked.
    """
    t, seed = Threshold(num, den), 0
    while True:  # two different sets with one 64-bit name would be merged: then hash anew
        sets = materialise(set_table(docs, width, seed), "sets")
        rows = sets.filter("kind = 0").select("doc_id", "th", "n", "node", "proof", "bits")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("first")
        classes = materialise(rows.filter("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), first, F.min("proof").alias("lo"), F.max("proof").alias("hi")), "classes")
        if classes.filter("lo <> hi").isEmpty():
            break
        release(sets)
        release(classes)
        seed += 1
    comps = _components(docs, classes, sets.filter("kind > 0").select("kind", "x", "y"), width, seed, t)
    named = materialise(_named(classes, comps), "named")
    release(classes)
    if comps is not None:
        release(comps)
    out = rows.filter("n > 0").select("doc_id", "th", "n", "node").join(named, "node").select("doc_id", "th", F.col("n").alias("n_shingles"), F.col("head.doc_id").alias("component_id"), (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("th") == F.col("head.th"))).alias("keep"))
    blank = rows.filter("n = 0").select("doc_id", "th", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("keep"))
    return out.unionByName(blank)


def _named(classes: DataFrame, comps: DataFrame | None) -> DataFrame:
    """node, head: the first row of each set's component. Heads of components are few rows and are broadcast where their count
    allows it; else both sides of that join are plain tables, so that a component with very many sets can be split."""
    alone = classes.select("node", F.col("first").alias("head"))
    if comps is None:
        return alone
    linked = materialise(comps.join(classes.select("node", "first"), "node"), "linked")
    heads = materialise(linked.groupBy("comp").agg(F.min("first").alias("head")), "heads")
    return linked.join(_small(heads), "comp").select("node", "head").unionByName(alone.join(linked.select("node"), "node", "left_anti"))


def _small(rows: DataFrame) -> DataFrame:
    """A materialised narrow table, to be broadcast if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _components(docs: DataFrame, classes: DataFrame, facts: DataFrame, width: int, seed: int, t: Threshold) -> DataFrame | None:
    """node, comp of every set that is linked with another; None without links."""
    most = classes.agg(F.max("n")).first()[0]
    if not most:
        return None
    lows = bounds(most, t)
    if most < lows[0]:
        return None
    per_band = dict.fromkeys(range(len(lows)), 0)
    number = sum((F.col("n") >= low).cast("int") for low in lows) - 1
    per_band |= {r.band: r.k for r in classes.groupBy(number.alias("band")).agg(F.count("*").alias("k")).collect()}  # a few dozen rows
    common, overlap = measured(facts)
    plan = [allocate(low, high, per_band[i] + per_band.get(i + 1, 0), t, overlap) for i, (low, high) in enumerate(zip(lows, lows[1:], strict=False))]

    index = docs.select("text").filter("text <> ''").mapInArrow(_index(width, seed, t, plan, common), "key bigint, a bigint, b bigint")
    stars = index.repartition("key").sortWithinPartitions("key", "a").mapInArrow(_stars, "a bigint, b bigint, big boolean")
    edges = materialise(stars.groupBy("a", "b").agg(F.max("big").alias("big")), "stars")
    if edges.isEmpty():
        return None
    decided = materialise(_possible(edges, classes, t), "possible")
    release(edges)
    maybe = decided.filter("possible").select("a", "b")
    ends = maybe.select(F.col("a").alias("node")).unionByName(maybe.select(F.col("b").alias("node"))).distinct()
    texts = materialise(_fetch(docs, classes, ends), "texts")
    links = materialise(_verify(maybe, texts, width, seed, t), "links")
    release(texts)
    if links.isEmpty() and decided.filter("big").isEmpty():
        return None
    comps = connected(links)
    clusters = connected(decided.filter("big").select("a", "b").unionByName(links))
    release(decided)
    release(links)
    more = _decide_rest(docs, clusters, comps, classes, width, seed, t)
    if more is None:
        return comps
    out = connected(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(more))
    release(clusters)
    release(comps)
    return out


def component_table(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; see ``groups``."""
    return groups(docs, width, num, den).select("doc_id", "n_shingles", "component_id")


def distinct(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each component, the first by (doc_id, text hash), and every row without words.

    Of repeated rows (equal doc_id and text) one stays.
    """
    kept = groups(docs, width, num, den).filter("keep").select(F.col("doc_id").alias("head_id"), F.col("th").alias("head_th")).distinct()
    kept = materialise(kept, "kept")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("bigint").alias("head_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    joined = rows.join(kept, rows["head_id"].eqNullSafe(kept["head_id"]) & (rows["hash"] == kept["head_th"]), "left_semi")
    return joined.dropDuplicates(["head_id", "hash"]).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
