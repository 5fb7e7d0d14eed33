import random
import re
from collections import Counter

import numpy as np
import pytest

from brindle.llm import jaccard as j
from brindle.llm.components import connected
from brindle.llm.shingles import shingle_sets


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, width, num, den):
    sets = [shingles(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for k in range(i):
            a, b = sets[i], sets[k]
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = root(i), root(k)
                up[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return Counter((d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def corpus(seed, groups, size):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["É", "The", "of"]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.randrange(*size))]
        for _ in range(rng.choice([1, 1, 2, 4, 25])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.randrange(2)] = [rng.choice(vocab)] * rng.randrange(2)
            rows.append((len(rows), rng.choice([" ", "  ", "\n"]).join(w)))
    rows += [(9000, None), (9001, ""), (9001, " \t"), (None, rows[0][1]), (9002, "One two"), (9003, "one TWO"), (9004, "one"), (9005, "x"), (9005, rows[3][1]), (9005, rows[3][1]), (9006, "a b c"), (9007, "A b\x0bC"), (9008, "y " * 3000)]
    return rows


@pytest.mark.parametrize("seed,size,width,num", [(1, (8, 60), 3, 90), (2, (40, 400), 3, 90), (3, (4, 40), 5, 80), (4, (60, 300), 5, 80)])
def test_components_equal_brute_force(spark, seed, size, width, num):
    rows = corpus(seed, 60, size)
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, n int, node int").repartition(3)
    got = Counter(tuple(r) for r in j.component_table(docs, width, num, 100).collect())
    assert got == brute(rows, width, num, 100)


def test_distinct(spark):
    rows = corpus(5, 30, (30, 200))
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id bigint, text string, th string")
    kept = j.distinct(docs)
    assert kept.columns == docs.columns
    want = {c for _, n, c in brute(rows, 5, 80, 100) if n}
    ids = Counter(r.doc_id for r in kept.collect() if shingles(r.text, 5))
    assert set(ids) == want and max(ids.values()) == 1
    assert {r.doc_id for r in kept.collect()} >= {9000, 9001}
    assert j.distinct(docs.limit(0)).count() == 0 and j.component_table(docs.limit(0)).count() == 0


def test_pigeonhole_never_misses():
    rng = np.random.default_rng(6)
    for num in (90, 80, 60):
        t = j.Threshold(num, 100)
        lows = j.bounds(3000, t)
        for _ in range(300):
            n = int(rng.integers(lows[0], 900))
            base = rng.integers(1, 2**63, n).astype(np.uint64)
            drop = int(rng.integers(0, t.most_apart(n) + 1))
            other = np.concatenate([base[: n - drop // 2], rng.integers(1, 2**63, drop - drop // 2).astype(np.uint64)])
            i, u = len(np.intersect1d(base, other)), len(np.union1d(base, other))
            if 100 * i < num * u or not drop:
                continue
            small = min(len(base), len(other))
            number = int(np.searchsorted(lows, small, side="right")) - 1
            h = t.most_apart(lows[number + 1] - 1)
            bands = [j.allocate(lows[number], lows[number + 1], k, t) for k in (1, 10**4, 10**9)]
            bands += [j.Band(lows[number], lows[number + 1], h + 1 + skip + 2 - 2 * d, d, skip, 2) for d in (0, 1, 3) for skip in (0, 2, h) if h + 3 - 2 * d >= 0]
            bands += [j.Band(lows[number], lows[number + 1], 0, h // 2 + 2 * skip + 1, skip, 0) for skip in (0, 1, h // 3)]
            common = np.sort(np.concatenate([rng.choice(base, len(base) // 3, replace=False), rng.integers(1, 2**63, 50).astype(np.uint64)]))
            for band in bands:
                for c in (None, common):
                    assert set(j.signatures(base, number, band, c).tolist()) & set(j.signatures(other, number, band, c).tolist())
            size = min(len(j.bitmap(base)), len(j.bitmap(other)))
            apart = int(np.bitwise_count(j.fold(j.bitmap(base), size) ^ j.fold(j.bitmap(other), size)).sum())
            assert apart <= u - i <= t.apart(len(base), len(other))


def test_shingle_sets_batching():
    texts = ["", "a", "a b", "A  b c\td", "é x y z", "q " * 500, "z" * 70_000]
    together = shingle_sets([t.encode() for t in texts], 3)
    for t, s in zip(texts, together, strict=True):
        assert len(s) == len(shingles(t, 3)) and (s == shingle_sets([t.encode()], 3)[0]).all()


def test_stars_across_batches():
    import pyarrow as pa

    rng = random.Random(8)
    rows = sorted((rng.randrange(40), rng.randrange(30)) for _ in range(300))
    for cut in (1, 2, 3, 7, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[i : i + cut]]), pa.array([r[1] for r in rows[i : i + cut]]), pa.array([None] * len(rows[i : i + cut]), pa.int64())], schema=j._INDEX) for i in range(0, len(rows), cut)]
        got = {(a, b): big for x in j._stars(batches) for a, b, big in zip(*(c.to_pylist() for c in x.columns), strict=True) if big or True}
        want = {}
        for k in {r[0] for r in rows}:
            nodes = sorted({r[1] for r in rows if r[0] == k})
            for b in nodes[1:]:
                want[nodes[0], b] = want.get((nodes[0], b), False) or len(nodes) > 2
        assert set(got) == set(want)


def test_connected(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)] + [(5, 5)]
    got = {r.node: r.comp for r in connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    up = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    assert got == {k: v for k, v in up.items() if any(k in e and e[0] != e[1] for e in edges)}


def test_allocation_follows_what_is_measured():
    t = j.Threshold(90, 100)
    few, many = (j.allocate(497, 646, n, t, j.Overlap(((0.05, 1.0),))) for n in (100, 10**8))
    assert few.deleting == 0 and few.exact > 0 and many.exact == 0 and many.deleting > 0
    alone = j.allocate(497, 646, 10**8, t, j.Overlap(()))
    shared = j.allocate(497, 646, 10**5, t, j.Overlap(((0.05, 0.05),), 0.1))
    assert shared.skip > alone.skip


def test_facts_of_a_chunk():
    rng = np.random.default_rng(2)
    passage = rng.integers(1, 2**63, 40).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.integers(1, 2**63, 60).astype(np.uint64), passage if i % 2 else passage[:0], np.array([i // 3 + 5], np.uint64)])) for i in range(600)]
    rows = j.chunk_facts(sets)
    assert {x for k, x, _ in rows if k == 1} == set(passage.view(np.int64).tolist()) and all(y == 300 for k, _, y in rows if k == 1)
    assert next((x, y) for k, x, y in rows if k == 4) == (300 * 40, sum(map(len, sets)))
    probes = range(0, 600, 600 // j.PROBES)
    assert next(y for k, _, y in rows if k == 3) == 599 * len(probes)
    assert next(y for k, x, y in rows if k == 2 and x == 0) == 2 * len(probes)


@pytest.mark.parametrize("exact", [True, False])
def test_shared_passages_and_deleting_segments(spark, monkeypatch, exact):
    """A third of all texts share a long passage; with and without one-deletion segments chosen for every band."""
    rng = random.Random(21)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(f"u{rng.randrange(5000)}" for _ in range(rng.randrange(40, 120))) + (" " + passage if i % 3 == 0 else "")) for i in range(150)]
    rows += [(1000 + i, rows[i][1] + " tail") for i in range(0, 150, 4)]
    if not exact:
        monkeypatch.setattr(j, "allocate", lambda low, high, n, t, overlap: j.Band(low, high, 0, t.most_apart(high - 1) // 2 + 3, 1, 0))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert Counter(tuple(r) for r in j.component_table(docs, 3, 90, 100).collect()) == brute(rows, 3, 90, 100)
