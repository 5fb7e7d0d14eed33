import json

import pytest
from pyspark.sql import functions as F

from brindle.functions import json_tools as jt
from brindle.functions import logs as lg
from brindle.functions import text as tx
from brindle.operators import evaluation as ev
from brindle.operators import history as h
from brindle.operators import lexical as lx
from brindle.operators import sessions as ss
from brindle.operators import structural as st
from brindle.sources import history_text as src
from brindle.streaming import jobs


def test_json_minify_keeps_numbers_and_refuses_bad_documents():
    assert jt.minify('{ "a" : 1.10, "b": [ 1e3, "x \\" y" ] }') == '{"a":1.10,"b":[1e3,"x \\" y"]}'
    for bad in ('{"a":1,"a":2}', '{"a":1} x', "{a:1}", "[NaN]", "", "12", '{"a":1}'):
        assert jt.minify(bad) == bad
    assert jt.structure(json.dumps({"a": [{"b": 1}], "c": 2})) == "{\n  a: [{\n    b\n  }],\n  c\n}" and jt.structure("3") == ""
    assert jt.equal('{"a":1.0,"b":[1]}', '{"b":[1],"a":1}') and not jt.equal("[1,2]", "[2,1]") and jt.equal(None, "1") is None


def test_large_commits_make_no_pairs(spark):
    rows = [(1, f"f{i}") for i in range(51)] + [(2, f"f{i}") for i in range(50)] + [(3, "f0"), (3, "f0"), (3, "f1")]
    t = spark.createDataFrame(rows, "hash int, path string")
    pairs = {(r.file_a, r.file_b): r["count"] for r in h.cochange(t).collect()}
    assert len(pairs) == 50 * 49 // 2 and pairs["f0", "f1"] == 2


def test_covering_set_covers_every_byte():
    grams = lx.covering_set("ab cdef", {"6162": 9.0}, 1.0)
    assert grams[0] == ("6162", 9.0)
    assert lx.covering_set("a", {}, 1.0) == [] and lx.borders(b"ab cdef x") == [(0, 2), (0, 2), (3, 5), (5, 7), (7, 9)]
    with pytest.raises(ValueError):
        lx.covering_set("x" * 4097, {}, 1.0)
    with pytest.raises(ValueError):
        lx.Config(k1=-1).validate()


def test_bigrams_of_short_and_wide_texts(spark):
    rows = [(1, ""), (2, "a"), (3, "aaa"), (4, "é!"), (5, None)]
    got = {}
    for r in lx.bigram_positions(spark.createDataFrame(rows, "doc_id int, content string")).collect():
        got.setdefault(r.doc_id, []).append(r.key)
    assert got == {3: ["6161", "6161"], 4: ["C3A9", "A921"]}


def test_sessions(spark):
    calls = [("s", 1, "Bash", "git comit -m x", True, ""), ("s", 2, "Bash", "ls", False, ""), ("s", 3, "Bash", "git commit -m x", False, ""), ("s", 4, "Bash", "cargo tset", None, "error: no such command"), ("s", 5, "Bash", "cargo test", False, "ok"), ("s", 6, "Bash", "rm x", True, "Permission to use it has been denied"), ("s", 7, "Bash", "rm y", False, "")]
    df = spark.createDataFrame(calls, "session_id string, seq int, tool string, command string, is_error boolean, result string")
    got = {(r.command, r.fixed, r.kind) for r in ss.corrections(df).collect()}
    assert got == {("git comit -m x", "git commit -m x", "typo"), ("cargo tset", "cargo test", "typo")}
    cycle = [("t", i, "Bash", "pytest -q a", i % 2 == 1, "") for i in range(1, 8)]
    tdd = spark.createDataFrame(cycle, df.schema)
    assert {r.seq for r in ss.tdd_cycles(tdd).collect()} == {1, 3, 5} and ss.corrections(df.limit(0)).count() == 0


def test_history_log_and_transcripts(spark):
    log = ["COMMIT:a1|Ann|100|fix: x|y", "3\t1\tsrc/{old => new}/f.rs", "-\t-\tlogo.png", "", "COMMIT:b2|Bo|90|y", "x\t2\tg.py", "junk"]
    commits, changes = src.parse_history_log(spark.createDataFrame([("r", i, x) for i, x in enumerate(log)], "source string, line_no int, line string"))
    assert {(r.hash, r.message) for r in commits.collect()} == {("a1", "fix: x|y"), ("b2", "y")}
    assert {(r.hash, r.path, r.additions, r.deletions) for r in changes.collect()} == {("a1", "src/new/f.rs", 3, 1), ("b2", "g.py", 0, 2)}
    use = {"type": "assistant", "message": {"content": [{"type": "tool_use", "id": "1", "name": "Bash", "input": {"command": "ls"}}]}}
    res = {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "1", "content": "out", "is_error": True}]}}
    flat = {"type": "tool_use", "tool": "Read", "args": {"file_path": "p"}, "id": "9"}
    lines = spark.createDataFrame([("s", i, x) for i, x in enumerate([json.dumps(use), "{bad", json.dumps(res), json.dumps(flat)])], "session_id string, line_no int, line string")
    assert [tuple(r) for r in src.parse_sessions(lines).orderBy("seq").collect()] == [("s", 1, "Bash", "ls", True, "out"), ("s", 2, "Read", "p", None, None)]


def test_structural(spark):
    files = spark.createDataFrame([(1, "for a in b:\n  for c in d:\n    f(c)\n"), (2, "x = 1\n"), (3, "def (")], "doc_id bigint, content string")
    nodes = st.node_table(files)
    grams = st.ngrams(nodes)
    langs = files.select("doc_id", F.lit("python").alias("lang"))
    got = st.search(grams, nodes, st.idf(grams, langs), langs, "For > For").collect()
    assert [r.doc_id for r in got] == [1] and got[0].score > 0
    assert len(st.PATTERNS) == 29 and st.parse_query("nested-loop")[1] and st.parse_query("A > B > C") == ([], [("A", "B", "C")])
    for bad in ("", "A >> B", "no-such", "A > B > C > D", "A >"):
        with pytest.raises(ValueError):
            st.parse_query(bad)


def test_frames_and_logs(spark):
    frames = spark.createDataFrame([(1, 0, i, f"at {i}") for i in range(5)] + [(1, 1, 9, "x")], "doc_id int, entry int, pos int, frame string")
    assert {r.entry: (r.frames, r.elided) for r in lg.last_frames(frames).collect()} == {0: (["at 2", "at 3", "at 4"], 2), 1: (["x"], 0)}
    j = spark.createDataFrame([('{"lvl":"warn","msg":"m"}',)], "x string").select(lg.json_level(F.col("x")).alias("l"), lg.json_message(F.col("x")).alias("m")).first()
    assert (j.l, j.m) == ("WARN", "m")


def test_tree_and_refresh(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "b.bin").write_bytes(b"\xff\xfe")
    (tmp_path / "c.js").write_text("y" * 900)
    rows = src.read_tree(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1]: r.skip_reason for r in rows.collect()} == {"a.py": None, "b.bin": "not_utf8", "c.js": "minified"}
    assert src.changed_files(rows, rows.filter("lang = 'python'")).count() == 2


def test_tuning_and_gates(spark):
    best, top = ev.coordinate_descent(lambda c: 1 - abs(c["a"] - 3) - abs(c["b"] - 1), {"a": 1.0, "b": 1.0}, {"a": [2.0, 3.0], "b": [0.0, 1.0]})
    assert best == {"a": 3.0, "b": 1.0} and top == 1
    r = spark.range(1).select(tx.elision_marker(F.lit(5), F.lit(3)).alias("m"), tx.byte_gate(F.lit("ab"), F.lit("abc")).alias("g"), tx.tidy(F.lit("a  \n\n\n\n\nb")).alias("t"), tx.strip_ansi(F.lit("\x1b[31mx\x1b[0m")).alias("a")).first()
    assert (r.m, r.g, r.t, r.a) == ("... 2 more (3 of 5 shown)", "ab", "a\n\n\nb", "x")


def test_streams(spark, tmp_path):
    rows = [("j", 1, "Queued"), ("j", 2, "Queued"), ("j", 3, "error: x"), ("j", 4, "Queued"), ("j", 5, "Done"), ("k", 1, "Queued")]
    spark.createDataFrame(rows, "job string, seq bigint, status string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("job string, seq bigint, status string").parquet(str(tmp_path / "in"))
    q = jobs.job_transitions(stream).writeStream.format("memory").queryName("moves").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("moves").collect()} == {("j", 1, "Queued"), ("j", 3, "error: x"), ("j", 5, "Done"), ("k", 1, "Queued")}
    chunks = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 1, "zzz")], "request_id string, chunk_no int, data string")
    assert {r.request_id: (r.body, r.accepted) for r in jobs.assemble_chunks(chunks, 2).collect()} == {"a": ("xy", True), "b": (None, False)}
