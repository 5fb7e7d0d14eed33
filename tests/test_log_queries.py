from collections import Counter

from brindle.plans.text_queries import QUERIES


def test_log_queries_read_every_line_whole(spark, tmp_path):
    lines = [f"line {i % 44} of a long log" for i in range(100)]
    lines[97], lines[98] = "LINE 9 of a long log", ""
    docs = [(1, "\n".join(lines)), (2, "same start, end a\n\n\n\nsame start, end b\n\n\n\nsame start, end a"), (3, ""), (4, None)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for doc, text in docs:
        for pos, raw in enumerate((text or "").split("\n") if text is not None else []):
            level = ("INFO", "ERROR", None, "DEBUG")[pos % 4]
            ts = f"2024-01-02T03:04:{pos % 60:02}Z" if pos % 3 == 0 else None
            if raw.strip() or level or ts:
                want.append((doc, pos, ts, level, raw))
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, run("log_entries")), key=lambda r: r[:2]) == want

    for name, fold, hidden in (("log_deduplicate", str.lower, "DEBUG"), ("log_deduplicate_lossless", str, "")):
        groups = {}
        for doc, pos, ts, level, message in want:
            if level != hidden:
                groups.setdefault((doc, level, fold(message)), []).append((pos, ts, message))
        stamps = {k: [ts for _, ts, _ in g if ts] or [None] for k, g in groups.items()}
        expected = {(k[0], g[0][0], k[1], g[0][2], len(g), stamps[k][0], stamps[k][-1]) for k, g in groups.items()}
        got = [tuple(r) for r in run(name)]
        assert len(got) == len(expected) and set(got) == expected

    total, debug = Counter(w[0] for w in want), Counter(w[0] for w in want if w[3] == "DEBUG")
    unique = Counter(k[0] for k in {(w[0], w[3], w[4].lower()) for w in want if w[3] != "DEBUG"})
    assert {tuple(r) for r in run("log_totals")} == {(d, n, debug[d], unique[d], max(n - unique[d] - debug[d], 0)) for d, n in total.items()}
