import re
from collections import defaultdict
from fractions import Fraction

import pytest

from brindle.llm import mixing

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, taken string"


def make(spark, spec):
    rows, i = [], 0
    for source, sizes in spec.items():
        for n in sizes:
            rows.append((i, None if n is None else " ".join(f"w{k}" for k in range(n)), "en", source, 0, "x"))
            i += 1
    return spark.createDataFrame(rows, SCHEMA)


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(names)}
    total, fixed = Fraction(sum(sizes.values())), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if level * weight[s] > cap * sizes[s]]
        if not over:
            return {s: float(fixed.get(s, level * weight[s])) for s in names}
        fixed |= {s: Fraction(cap * sizes[s]) for s in over}


@pytest.mark.parametrize(
    "spec",
    [
        {"a": [100, 50, 3], "b": [400] * 5, None: [7, None, 0, 20]},
        {"a": [1], "b": [2000, 3], "c": [5] * 40, "d": [10] * 10, "é": [], "z": [0, None]},
        {"only": [3, 4, 5]},
        {None: [9, 1]},
        {"a": [0, None], "b": [None]},
        {"A": [17] * 300, "a": [1, 5000], "b": [30] * 20, "c": [8]},
    ],
)
def test_targets_and_taken(spark, spec):
    docs = make(spark, spec)
    got = mixing.sample(docs).collect()
    again = {r.doc_id: r.taken for r in mixing.sample(docs.repartition(3)).collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        assert 0 <= r.taken <= 3 * r.size and again[r.doc_id] == r.taken
    want = brute_targets(sizes)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and r.epochs * r.size <= r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert len(got) == docs.count()


def test_apply_and_empty(spark):
    docs = make(spark, {"a": [100, 50, 3], "b": [400] * 5, None: [7, None, 0, 20]})
    want = {r.doc_id: (r.taken, r.size) for r in mixing.sample(docs).collect()}
    got = defaultdict(int)
    for r in mixing.apply(docs).collect():
        got[r.doc_id] += 1
        assert r.taken == "x" and len(re.findall(r"\S+", r.text)) == want[r.doc_id][1]
    assert dict(got) == {i: (2 * n + size) // (2 * size) for i, (n, size) in want.items() if size and 2 * n >= size}
    assert mixing.sample(docs.limit(0)).count() == 0 and mixing.apply(docs.limit(0)).columns == docs.columns


def test_low_qualities_fill_no_range(spark):
    """One source of repetitive texts, all of the lowest quality: no key range holds much of it."""
    docs = spark.range(40_000).selectExpr("id AS doc_id", "repeat('x\n', 30) AS text", "'one' AS source")
    from pyspark.sql import functions as F

    assert docs.select(mixing.quality(F.col("text"), F.lit(30)).alias("q")).distinct().collect()[0].q == 0.05
    keyed = docs.selectExpr("(-ln((conv(substr(md5(cast(doc_id AS string)), 1, 13), 16, 10) + 0.5) / 4503599627370496)) / 0.05 AS key")
    for steps in (16, 64):
        most = keyed.groupBy(F.floor(F.log("key") * steps)).count().agg(F.max("count")).first()[0]
        assert most <= 40_000 / 2.718 / steps * 1.25
    got = mixing.sample(docs)
    assert got.agg(F.sum("taken"), F.max("target")).first() == (40_000 * 30, 40_000 * 30.0)


def test_very_long_text_and_repeated_rows(spark):
    rows = [(1, "w " * 300_000, "a"), (2, "é\tb", "a"), (2, "é\tb", "a"), (None, None, None), (None, "", None), (5, " \n", "b")]
    got = {}
    for r in mixing.sample(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect():
        got.setdefault(r.doc_id, []).append((r["size"], r.taken))
    assert got[1][0][0] == 300_000 and sum(t for v in got.values() for _, t in v) == 300_004 and len(got[2]) == 2
    assert got[None] == [(0, 0), (0, 0)]
