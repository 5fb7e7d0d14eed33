"""The five stages of the corpus pipeline, each held against a brute-force version on the rows its predecessor wrote."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline as cp
from brindle.llm import mixing, pii, toxicity
from brindle.llm.common import materialise

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, __toxicity string, __redacted string, __hash string"


def fixture(rng):
    vocab = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "ri") for b in ("ta", "so", "ven", "dor", "lim")]
    rows, labels = [], []
    for i in range(260):
        words = [rng.choice(vocab) + str(rng.randrange(30)) for _ in range(rng.randrange(12, 90))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["scumbag", "idiotic"])
        if i % 9 == 1:
            words[3] = f"joe{i}@mail.example.org"
        rows.append((i, " ".join(words), rng.choice(["a", "b", None])))
        labels.append((i, int(toxic)))
    for k in (1, 2, 4, 7, 11):  # near and exact copies of clean documents
        rows.append((1000 + k, rows[k][1], "a"))
        w = rows[k][1].split() * 1
        rows.append((2000 + k, " ".join(w + ["end"]), "b"))
    rows += [(3000, None, "a"), (3001, "", "b"), (3002, " \n", None), (None, "no id at all here", "a"), (3003, "café " * 30_000, "c"), (3004, "same row", "a"), (3004, "same row", "a")]
    return [(i, t, "en", s, None if t is None else len(t), "x", "y", "z") for i, t, s in rows], labels


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    rows, labels = fixture(random.Random(14))
    folder = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{folder}/labels.parquet")
    frames = [spark.read.parquet(f"{folder}/documents.parquet")]
    for name, stage in cp.STAGES:
        frames.append(materialise(stage(spark, frames[-1], folder), f"test-{name}"))
    return folder, dict(labels), frames


def as_rows(frame):
    return Counter(tuple(r) for r in frame.collect())


def test_names_and_columns(staged):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "jaccard", "pii", "mixing", "bpe"]
    assert all(f.columns == staged[2][0].columns for f in staged[2][:-1])
    assert all(f.schema == staged[2][0].schema for f in staged[2][:-1])


def test_toxicity_stage(staged, spark):
    folder, labels, frames = staged
    model = toxicity.train(frames[0], spark.read.parquet(f"{folder}/labels.parquet"))
    entries = dict(model.entries)

    def brute(text):
        words = toxicity.fold(text or "").split()
        weight = sum(max([entries.get(f" {w} ", 0), *(entries.get(f" {w[:k]}", 0) for k in toxicity.PREFIX if k <= len(w))]) for w in words)
        return 1 / (1 + np.exp(-np.clip(model.slope * weight / (len(words) + 1) ** model.power + model.bias, -30, 30)))

    kept = as_rows(frames[1])
    assert kept == Counter({r: n for r, n in as_rows(frames[0]).items() if brute(r[1]) < 0.3})
    ids = {r[0] for r in kept}
    assert not [i for i, t in labels.items() if t and i in ids] and not [i for i, t in labels.items() if not t and i not in ids]


def test_jaccard_stage(staged):
    rows = sorted(as_rows(staged[2][1]).elements(), key=lambda r: (r[0] is None, r[0] or 0))
    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for k in range(i):
            if sets[i] and sets[k] and 100 * len(sets[i] & sets[k]) >= 80 * len(sets[i] | sets[k]):
                old, new = group[i], group[k]
                group = [new if g == old else g for g in group]
    want = Counter()
    for g in set(group):
        members = [rows[i] for i in range(len(rows)) if group[i] == g]
        want[members[0]] += 1  # the first by id; rows without words are groups of their own
    assert as_rows(staged[2][2]) == want


def test_pii_stage(staged):
    before, after = staged[2][2], staged[2][3]
    model = pii.train(before)
    want = Counter()
    for r in before.collect():
        text = r.text
        if text:
            spans = sorted(((s, e, k) for k, s, e in pii.all_spans(text, model, {})[1]), reverse=True)
            for s, e, k in spans:
                text = text[:s] + f"[{k.upper()}]" + text[e:]
        want[(r.doc_id, text, *tuple(r)[2:4], None if text is None else len(text), *tuple(r)[5:])] += 1
    assert as_rows(after) == want
    assert not [r for r in want if re.search(r"\w@\w+\.\w", r[1] or "")] and any("[EMAIL]" in (r[1] or "") for r in want)


def test_mixing_stage(staged):
    before, after = staged[2][3], as_rows(staged[2][4])
    rows = before.collect()
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += size(r)
    for r, n in after.items():
        taken[r[3]] += n * len(re.findall(r"[^\x20\x09-\x0D]+", r[1]))
    whole = {tuple(r) for r in rows}
    assert all(r in whole for r in after)
    target = {}
    for r in mixing.sample(before).select("doc_id", "target", "size").collect():
        target[r.doc_id] = r.target
    longest = {s: max(size(r) for r in rows if r.source == s) for s in sizes}
    for r in rows:
        if size(r):
            assert abs(taken[r.source] - target[r.doc_id]) <= longest[r.source] / 2 + 1
        else:
            assert tuple(r) not in after


def test_bpe_stage(staged):
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for r in staged[2][4].collect():
        ids = library.encode_ordinary(r.text or "")
        want[(r.doc_id, np.array(ids, "<u4").tobytes(), len(ids))] += 1
    assert Counter((r.doc_id, bytes(r.ids), r.n_tokens) for r in staged[2][5].collect()) == want


def test_run_and_empty_tables(staged, spark, tmp_path):
    folder, _, frames = staged
    got = Counter((r.doc_id, bytes(r.ids), r.n_tokens) for r in cp.run(spark, folder).collect())
    assert got == Counter((r.doc_id, bytes(r.ids), r.n_tokens) for r in frames[5].collect())
    frames[0].limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
