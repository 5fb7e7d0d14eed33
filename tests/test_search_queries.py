import math
import random
from collections import Counter

from brindle.operators import lexical as lx
from brindle.plans.search_queries import QUERIES
from brindle.sources.sinks import write_lexical_index


def test_selectivity_of_whole_texts(spark, tmp_path):
    docs = ["the quick brown fox", "the lazy dog", "a quick end", "the lazy dog"]
    start = "the quick brown fox jumps over the lazy dog"
    items = [(1, start + " and ends here"), (2, start + " with another end"), (3, start + " and ends here"), (4, "x"), (5, "")]
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(docs)], "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = Counter(g for t in set(docs) for g in {t[i : i + 2] for i in range(len(t) - 1)})
    idf = {g: math.log(len(set(docs)) / (n + 1)) + 1 for g, n in df.items()}
    got = {r.item_id: (r.query, r.selectivity) for r in QUERIES["search_selectivity"](spark, str(tmp_path)).collect()}
    assert len(got) == len(items)
    for item, text in items:
        assert got[item][0] == text and abs(got[item][1] - sum(idf.get(text[i : i + 2], 0) for i in range(len(text) - 1))) < 2e-3


def test_index_and_scan_agree(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        text = "".join(rng.choice("ab cdé\n") for _ in range(rng.randrange(0, 90)))
        n = len(text.encode())
        ranges = [(a, min(n, a + rng.randrange(1, 40)), rng.randrange(8)) for a in (0, n // 3, n // 2)] if n and i % 3 else []
        rows.append((i, text, rng.choice(["en", "de"]), ranges))
    rows += [(100, None, "en", []), (101, rows[3][1], "de", None), (102, "a", "en", [])]
    files = spark.createDataFrame(rows, "doc_id bigint, content string, lang string, field_map array<struct<start:int,end:int,field:int>>").repartition(3)
    key = lambda r: (r.key, r.doc_id)
    assert sorted(lx.term_counts(files).collect(), key=key) == sorted(lx.term_frequency(lx.postings(files)).collect(), key=key)
    index = write_lexical_index(files, str(tmp_path / "index"))
    keys, weights = ["6162", "2061", "6162", "C3A9", "FFFF"], index.weights()
    df = Counter(g for t in {r[1] for r in rows if r[1]} for g in {t.encode()[k : k + 2] for k in range(len(t.encode()) - 1)})
    assert {r.key: r.df for r in index.read("df").collect()} == {g.hex().upper(): n for g, n in df.items()}
    allow = lx.intersect([files.filter("doc_id > 10"), files.filter("doc_id < 50"), files.filter("doc_id > 20")])
    assert sorted(r.doc_id for r in allow.collect()) == list(range(21, 50))
    for options in ({}, {"lang": "en"}, {"allow": allow, "lang": "de"}, {"config": lx.STRUCTURAL, "default_idf": 2.0}):
        scan, stored = (sorted(tuple(r) for r in f.collect()) for f in (lx.search(files, keys, weights, **options), index.search(keys, **options)))
        assert scan == stored and (scan or "allow" in options)
    assert index.search([]).count() == 0
    assert "Scan parquet" in (plan := index.terms(keys)._jdf.queryExecution().executedPlan().toString()) and "PushedFilters: [In(key" in plan
