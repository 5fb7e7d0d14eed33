import random
import time
import zlib

import pytest

from brindle.llm import toxicity as t


def corpus(seed=1, n=900):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("aeiounrstl") for _ in range(rng.randrange(2, 8))) for _ in range(1500)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randrange(20, 400))]
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(["idiot", "scumbag", "zzqu" + rng.choice(["a", "ento", "is"])])
        docs.append((i, " ".join(words), "en", 1.0))
        labels.append((i, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, score double")
    lab = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id bigint, toxic int")
    return docs, dict(labels), d, lab, t.train(d, lab)


def test_fold():
    assert t.fold("1D10T, Ѕtupid sсum​!") == " idiot  stupid scum  "
    assert t.fold("ｉｄｉｏｔ") == " idiot "


def test_held_out_accuracy(fitted):
    docs, labels, d, _, model = fitted
    got = {r.doc_id: r for r in t.score_table(d, model).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    out = [r for r in got.values() if r.held_out]
    assert sum(r.predicted == labels[r.doc_id] for r in out) >= 0.98 * len(out)
    assert {r.doc_id for r in t.reject(d, model).collect()} == {i for i, r in got.items() if not r.predicted}


def test_disguise_exceptions_and_edges(fitted, spark):
    model = t.Model(fitted[4].entries, ("idiot proof",), fitted[4].slope, fitted[4].bias, fitted[4].power)
    a = t._automaton(model)
    plain = t.hits("such an idiot here", a)[0]
    assert plain > 0 and t.hits("such an 1d1оt here", a)[0] == plain and t.hits("an idiot-proof plan", a)[0] == 0
    rows = [(1, None), (2, ""), (None, "x"), (4, "idiot " * 40_000), (4, "idiot " * 40_000)]
    got = t.score_table(spark.createDataFrame(rows, "doc_id bigint, text string"), model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 4}) == 1


def test_no_labels(fitted, spark):
    d = fitted[2]
    empty = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert t.score_table(d, t.train(d, empty)).filter("predicted = 1").count() == 0
    assert t.score_table(d.limit(0), fitted[4]).count() == 0


def test_many_excused_hits_take_linear_time():
    model = t.Model(((" idiot ", 3.0), (" proof", 1.0)), ("idiot proof",), 1.0, 0.0, 1.0)
    a = model.automaton()
    start = time.time()
    assert t.hits("idiot proof " * 170_000, a)[0] == 0
    assert time.time() - start < 20
    assert t.hits("idiot - proof", a)[0] == 0 and t.hits("an idiot. Proof: idiot", a)[0] == 3.0


def test_excused_hits_against_brute_force():
    rng = random.Random(4)
    phrases = ("a b", "b c d", "d a")
    entries = tuple((f" {w} ", float(i + 1)) for i, w in enumerate("abcde"))
    a = t.Model(entries, phrases, 1.0, 0.0, 1.0).automaton()
    for _ in range(300):
        words = [rng.choice("abcde") for _ in range(rng.randrange(12))]
        covered = set()
        for p in map(str.split, phrases):
            covered.update(k for i in range(len(words)) if words[i : i + len(p)] == p for k in range(i, i + len(p)))
        assert t.hits(" ".join(words), a)[0] == sum(ord(w) - 96.0 for i, w in enumerate(words) if i not in covered)


def test_training_rows_are_bounded_and_distinct(spark):
    d = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "same")] * 50 + [(None, "x"), (4, None)], "doc_id bigint, text string")
    lab = spark.createDataFrame([(i, 1) for i in range(1, 9)], "doc_id bigint, toxic int")
    assert t.training_rows(d, lab, 20).count() == 20
    assert t.training_rows(d.filter("doc_id = 2"), lab).count() <= 1
