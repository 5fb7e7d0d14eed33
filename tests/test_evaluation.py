import random
import time
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from brindle.operators import evaluation as ev
from brindle.sources import scratch


def expected(rows, thresholds, most, limit):
    listed, of = Counter(r[0] for r in rows), {}
    for h, path, train in rows:
        of.setdefault((h, train), set()).add(path)
    known = {p for (_, train), files in of.items() if train for p in files}
    small = [files for (h, train), files in of.items() if train and listed[h] <= limit]
    n, both = Counter(p for f in small for p in f), Counter(ab for f in small for ab in permutations(f, 2))
    jaccard = {(a, b): round(c / (n[a] + n[b] - c), 6) for (a, b), c in both.items()}
    tests = [files & known for (_, train), files in of.items() if not train]
    tests = [f for f in tests if 2 <= len(f) <= most]
    out = {}
    for t in thresholds:
        found = {a: {b for (x, b), j in jaccard.items() if x == a and j >= t} for a in known}
        per = [[(len(found[a] & f), len(found[a]), len(f) - 1) for a in f] for f in tests]
        h, p, a = (sum(x[i] for f in per for x in f) for i in range(3))
        up, ur = h / p if p else 0, h / a
        mp, mr = (sum(sum(x[0] / x[i] if x[i] else 0 for x in f) / len(f) for f in per) / len(per) for i in (1, 2))
        f1 = lambda x, y: 2 * x * y / (x + y) if x + y else 0
        out[t] = (len(tests), up, ur, f1(up, ur), mp, mr, f1(mp, mr))
    return out


@pytest.mark.parametrize("slices", [False, True])
def test_cochange_predictions_against_brute_force(spark, monkeypatch, slices):
    if slices:
        monkeypatch.setattr(ev, "SLICE", 4)
        monkeypatch.setattr(ev, "TASK_PAIRS", 7)
    rng = random.Random(7)
    rows = [(h, p, h % 4 > 0) for h in range(80) for p in ["hub"] + [f"f{min(rng.randrange(30), rng.randrange(30))}" for _ in range(rng.randrange(0, 7))]]
    rows += [(100, f"f{i}", True) for i in range(12)] + [(101, f"f{i}", False) for i in range(14)] + [(102, "new", False), (102, "f1", False), (103, "only", True)]
    thresholds = (0.02, 0.15, 0.9, 1.0)
    got = ev.predict_cochange(spark.createDataFrame(rows, "hash bigint, path string, train boolean").repartition(3), thresholds, most=13, limit=10).collect()
    want = expected(rows, thresholds, 13, 10)
    assert len(got) == len(want)
    for r in got:
        assert r[1] == want[r[0]][0] and list(r[2:]) == pytest.approx(want[r[0]][1:], abs=2e-6)


def test_cochange_without_test_commits(spark):
    rows = spark.createDataFrame([(1, "a", True), (1, "b", True), (2, "a", False)], "hash bigint, path string, train boolean")
    assert ev.predict_cochange(rows).collect() == []


def test_written_tables_leave_no_shuffle_files(spark):
    def data_files():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for f in files.mkString("\n").split("\n") if f.endswith(".data")}

    before = data_files()
    df = scratch.written(spark.range(10_000).groupBy((F.col("id") % 977).alias("k")).agg(F.count("*").alias("n")), "counts")
    for _ in range(50):
        if not (left := data_files() - before):
            break
        time.sleep(0.1)
    assert not left and df.count() == 977
    scratch.release(df)
    assert not scratch.exists(spark, df._scratch_path)
