"""History metrics against their definitions written out in plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from brindle.operators import history as h
from brindle.operators.numbering import number_rows

NOW = 1_000_000_000


@pytest.fixture(scope="module")
def repo(spark):
    rng = random.Random(31)
    names = ["a/x", "a/y", "b/x", "b/deep/z", "README", "hot/log"]
    commits, touches = [], []
    for i in range(160):
        fix = rng.random() < 0.2
        commits.append((i, NOW - rng.randrange(90) * 86_400, rng.choice("pqr"), fix))
        files = ["README"] if i % 8 == 0 else rng.sample(names, rng.randrange(1, 5)) + (["hot/log", "hot/log"] if i % 3 == 0 else [])
        touches += [(*commits[-1], f) for f in files]
    commits.append((160, NOW, "p", True))
    touches += [(*commits[-1], "lone/fix")]
    c = spark.createDataFrame(commits, "hash int, ts bigint, author string, is_fix boolean")
    return commits, touches, c, spark.createDataFrame(touches, "hash int, ts bigint, author string, is_fix boolean, path string")


def files_of(touches):
    out = {}
    for hash_, *_, path in touches:
        out.setdefault(hash_, []).append(path)
    return out


def test_risk_is_decayed_on_both_sides(repo):
    _, touches, _, t = repo
    weight, fixed = {}, {}
    for _, ts, _, fix, path in touches:
        w = math.exp(-(NOW - ts) / 86_400 / 30)
        weight[path] = weight.get(path, 0) + w
        fixed[path] = fixed.get(path, 0) + w * fix
    for r in h.file_risk(t, NOW).collect():
        assert r.score == pytest.approx(weight[r.path] / max(weight.values()), abs=2e-6)
        assert r.fix_density == pytest.approx(fixed[r.path] / weight[r.path], abs=2e-6)


def test_fix_after_touch(repo):
    commits, touches, c, t = repo
    order = [x[0] for x in sorted(commits, key=lambda x: (-x[1], x[0]))]
    fix = {x[0]: x[3] for x in commits}
    at = {}
    for hash_, *_, path in touches:
        at.setdefault(path, []).append(order.index(hash_))
    for window in (1, 5, 500):
        for r in h.fix_after_touch(t, c, window).collect():
            own = at[r.path]
            keyword = sum(fix[order[i]] for i in own)
            near = sum(not fix[order[i]] and any(fix[order[k]] and k in own for k in range(i + 1, min(i + 1 + window, len(order)))) for i in own)
            want = (0, 0, 0) if len(own) < 2 else tuple(100 * x / len(own) for x in (keyword, near, keyword + near))
            assert (r.keyword_pct, r.proximity_pct, r.combined_pct) == pytest.approx(want, abs=1e-5)
            assert r.insufficient == (len(own) < 2)


def test_blast_radius_counts_single_file_commits(repo):
    _, touches, _, t = repo
    own, shared, support = {}, {}, {}
    for files in files_of(touches).values():
        w = 1 / math.sqrt(len(files))
        for i, a in enumerate(files):
            own[a] = own.get(a, 0) + w
            for k, b in enumerate(files):
                if len(files) >= 2 and i != k and a != b:
                    shared[a, b] = shared.get((a, b), 0) + w
                    support[a, b] = support.get((a, b), 0) + 1
    want = {k: (round(v / own[k[0]], 6), support[k]) for k, v in shared.items() if v / own[k[0]] >= 0.3 and support[k] >= 3}
    radius = h.blast_radius(t, 0.3)
    assert {(r.path, r.other): (pytest.approx(r.confidence, abs=2e-6), r.support) for r in radius.collect()} == want
    assert {(r.file_a, r.file_b) for r in h.coupling(radius).collect()} == {tuple(sorted(k)) for k in want}


def test_root_files_belong_to_no_module(repo):
    _, touches, _, t = repo
    count, cross = {}, {}
    for files in files_of(touches).values():
        modules = {f.split("/")[0] for f in files if "/" in f}
        for m in modules:
            count[m] = count.get(m, 0) + 1
            cross[m] = cross.get(m, 0) + (len(modules) > 1)
    got = {r.module: (r.commits, r.cross_commits) for r in h.encapsulation(t).collect()}
    assert got == {m: (n, cross[m]) for m, n in count.items() if n >= 3} and "README" not in got


def test_heatmap_has_every_metric(repo):
    _, touches, c, t = repo
    heat = {r.path: r for r in h.heatmap(t, c, NOW).collect()}
    for r in h.stability(t, NOW).join(h.churn(t, c), "path").join(h.fix_after_touch(t, c).drop("touches"), "path").collect():
        assert all(getattr(heat[r.path], k) == v for k, v in r.asDict().items())
    assert heat["lone/fix"].combined_pct == 0 and heat["lone/fix"].insufficient
    kept, left = h.without_excluded(t.withColumn("path", F.when(F.col("path") == "README", "go.sum").otherwise(F.col("path"))), c)
    some = sum(set(f) != {"README"} for f in files_of(touches).values())
    assert left.count() == some < 161 and kept.filter("path = 'go.sum'").count() == 0


def test_numbering_over_many_ranges(spark):
    rows = [(None if i % 7 == 0 else i * 37 % 501, f"k{i:05}") for i in range(3000)]
    df = spark.createDataFrame(rows, "a int, b string").repartition(5)
    got = {r.b: r.n for r in number_rows(df, [F.col("a"), F.col("b")], "n", rows=100).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert got == {b: i for i, (_, b) in enumerate(order)}
    assert number_rows(df.limit(0), [F.col("a")], "n").count() == 0


def test_windows(repo):
    _, _, c, _ = repo
    row = lambda **k: tuple(h.window_start(c, NOW, **k).first())
    assert row(since=5, last=3) == (5, None, "several windows") and row(preset="all") == (0, None, None)
    assert row(preset="month") == (NOW - 30 * 86_400, None, None) and row(preset="no")[2] == "unknown window"
    assert row(last=500)[0] is None and row(last=500)[2] == "too few commits"
