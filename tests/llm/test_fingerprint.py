import hashlib
import random

import numpy as np

from brindle.llm import fingerprint as f


def words(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def names(text):
    """The phrase names of each level as sets."""
    sym, first, value, out = np.frombuffer(text.encode(), np.uint8), np.array([0]), None, []
    for _ in range(f.LEVELS):
        sym, first = f._level(sym, value, first)
        value = sym
        out.append(set(sym.tolist()))
    return out


def test_equal_substrings_share_interior_phrases_at_any_offset():
    rng = random.Random(1)
    core = words(rng, 700)
    a, b = names(words(rng, 200) + core + words(rng, 40)), names("x" * 3 + words(rng, 91) + core)
    inside = names(core)
    for level in range(4):
        shared = inside[level] & a[level] & b[level]
        assert len(shared) >= len(inside[level]) - 16, level


def test_batching_and_likeness():
    rng = random.Random(2)
    texts = ["", "a", "aaaa", "ab" * 50, "é" * 30, "\0\0\0", words(rng, 3), words(rng, 2000), "z" * 10_000] + [words(rng, rng.randrange(1, 300)) for _ in range(60)]
    counts, bins = f.sketches([t.encode() for t in texts])
    for i, t in enumerate(texts):
        c, b = f.sketches([t.encode()])
        assert (c[0] == counts[i]).all() and (b[0] == bins[i]).all()
    own = f.likeness(counts, bins, counts, bins)
    assert (own == 1).all()
    near, far = [], []
    for _ in range(40):
        t, u = words(rng, 400), words(rng, 400)
        e = f.edited(t, u)
        s = [f.to_string(*(x[0] for x in f.sketches([v.encode()]))) for v in (t, e, u)]
        near.append(f.compare(s[0], s[1]))
        far.append(f.compare(s[0], s[2]))
    assert min(near) > 0.35 and max(far) < 0.1 and 0.5 < np.mean(near) < 0.75


def plain_sketch(text):
    """The method written out for one text, symbol by symbol: (number of phrases, minima by bin) of each level."""
    mask = (1 << 64) - 1

    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & mask
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    def toss(row):
        out = []
        for i, x in enumerate(row):
            diff = (row[i - 1] if i else x ^ 1) ^ x
            low = (diff & -diff).bit_length() - 1
            out.append(2 * low + (x >> low & 1) if diff else 0)
        return out

    out, symbols = [], list(text.encode())
    values = [mix((b + 1) * 0x9E3779B97F4A7C15 & mask) for b in symbols]
    for level in range(f.LEVELS):
        runs = []
        for x, v in zip(symbols, values, strict=True):
            if runs and runs[-1][0] == x:
                runs[-1][2] += 1
            else:
                runs.append([x, v, 1])
        label = [x for x, _, _ in runs]
        for _ in range(4 if level else 3):  # 64-bit names need one more toss than bytes to come below 6
            label = toss(label)
        assert not label or max(label) < 6
        phrases = []
        for i, (_, v, n) in enumerate(runs):
            if i == 0 or (i + 1 < len(runs) and label[i] > label[i - 1] and label[i] > label[i + 1]):
                phrases.append([])
            phrases[-1].append((v + n * 0x9FB21C651E98DF25) & mask)
        symbols = [mix(sum(v * pow(0xD1342543DE82EF95, min(k, 63) + 1, 1 << 64) for k, v in enumerate(p)) & mask) for p in phrases]
        values = symbols
        least = {}
        for x in symbols:
            least[x >> 58] = min(least.get(x >> 58, 1 << 40), x >> 16 & 0xFFFFFFFE)
        out.append((len(symbols), {k: v & 0xFFFF for k, v in least.items()}))
    return out


def test_sketches_against_the_method_written_out():
    rng = random.Random(12)
    texts = ["", "a", "aaaaab", "ab" * 40, "é€" * 20, words(rng, 400), "z" * 5000 + "y", words(rng, 5)]
    counts, bins = f.sketches([t.encode() for t in texts])
    for i, t in enumerate(texts):
        for level, (n, least) in enumerate(plain_sketch(t)):
            assert counts[i, level] == n
            assert {k: int(v) for k, v in enumerate(bins[i, level]) if v != f._EMPTY} == least


def table_brute(rows, th):
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, th[r[1]], r[1]))
    want = []
    for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        e = f.edited(t, n)
        s = [f.to_string(*(x[0] for x in f.sketches([v.encode()]))) for v in (t, e, n)]
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), s[0], s[1], round(f.compare(s[0], s[1]), 9), round(f.compare(s[0], s[2]), 9)))
    return want


def check_table(spark, rows):
    frame = spark.createDataFrame([(*r, "b", True) for r in rows], "doc_id bigint, text string, range string, copy boolean").repartition(5)
    th = {r.text: r.th for r in frame.selectExpr("coalesce(text, '') AS text", "xxhash64(coalesce(text, '')) AS th").collect()}
    got = [(*tuple(r)[:5], round(r[5], 9), round(r[6], 9)) for r in f.fingerprints(frame).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[6])
    assert sorted(got, key=key) == sorted(table_brute(rows, th), key=key)
    return frame


def test_table_against_brute_force(spark):
    rng = random.Random(3)
    check_table(spark, [(i * 97, words(rng, rng.randrange(1, 50))) for i in range(120)] + [(-5, None), (10_000_000, ""), (97, "again"), (97, "again"), (None, "no id"), (5, words(rng, 9000))])
    one = spark.createDataFrame([(4, "just one")], "doc_id bigint, text string")
    assert [r.near_next for r in f.fingerprints(one).collect()] == [1.0]
    assert f.fingerprints(one.limit(0)).count() == 0


def test_sparse_equal_and_missing_ids_are_dealt_evenly(spark):
    from pyspark.sql import functions as F

    rng = random.Random(6)
    check_table(spark, [(rng.randrange(-(2**63), 2**63), words(rng, 6)) for _ in range(80)] + [(7, words(rng, 4)) for _ in range(60)])
    frame = check_table(spark, [(None, words(rng, rng.randrange(1, 20))) for _ in range(150)])
    rows = frame.select("doc_id", F.xxhash64("text").alias("th"), (F.octet_length("text") + 64).alias("bytes"))
    sizes = [r["count"] for r in rows.groupBy(f._range_of(f._bounds(rows))).count().collect()]
    assert len(sizes) > 10 and max(sizes) <= 30


def test_bounds_found_in_two_steps(spark):
    keys = [(False, 0, -5), *((True, 3 * i, 0) for i in range(1000))]
    frame = spark.createDataFrame([(i, 0) for i in range(-3, 3100, 7)] + [(None, -6), (None, 9)], "doc_id bigint, th bigint")
    for r in frame.withColumn("range", f._range_of(keys)).collect():
        assert r.range == sum(k <= (r.doc_id is not None, r.doc_id or 0, r.th) for k in keys)
