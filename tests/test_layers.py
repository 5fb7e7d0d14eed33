import json

import pytest
from pyspark.sql import functions as F

from brindle.functions import json_tools as jt
from brindle.functions import logs as lg
from brindle.functions import parsers, serde
from brindle.functions import text as tx
from brindle.operators import interfaces as itf
from brindle.operators import layers, lexical
from brindle.operators import structural as st
from brindle.sources import history_text as src


def test_layers_fit_their_seams(spark, tmp_path):
    files = spark.createDataFrame([(1, "the border of a nation", "en"), (2, "nothing", "en"), (3, "border", "de")], "doc_id bigint, content string, lang string")
    layer = layers.LexicalBuilder().build(files, str(tmp_path / "i"))
    assert isinstance(layer, itf.SearchLayer) and isinstance(layers.LexicalBuilder(), itf.LayerBuilder)
    assert {r.doc_id for r in layer.search("border").collect()} >= {1, 3} and layer.search("border", limit=1, offset=1).count() == 1
    code = spark.createDataFrame([(1, "for a in b:\n  for c in d:\n    f(c)\n"), (2, "x = 1\n")], "doc_id bigint, content string")
    nodes = st.node_table(code)
    deep = layers.StructuralLayer(lambda: st.ngrams(nodes), nodes, code.select("doc_id", F.lit("python").alias("lang")))
    assert isinstance(deep, itf.SearchLayer) and [r.doc_id for r in deep.search("For > For").collect()] == [1]
    log = spark.createDataFrame([("r", 0, "COMMIT:a|b|5|fix"), ("r", 1, "1\t2\tx.rs")], "source string, line_no int, line string")
    history = layers.LogHistory(log)
    assert isinstance(history, itf.HistorySource) and [x.count() for x in history.commits(spark)] == [1, 1]
    call = {"message": {"content": [{"type": "tool_use", "id": "1", "name": "Bash", "input": {"command": "ls"}}]}}
    lines = spark.createDataFrame([("s", 0, json.dumps(call))], "session_id string, line_no int, line string")
    for read in (src.parse_sessions, src.parse_call_sessions):
        provider = layers.Transcripts(lines, read)
        assert isinstance(provider, itf.SessionProvider) and provider.sessions(spark).first().command == "ls"
    records = spark.createDataFrame([(10, "t", "c", 100, 40, 1, "rust", "structure", "s")], "timestamp bigint, command_type string, original_cmd string, raw_tokens bigint, compressed_tokens bigint, duration_ms bigint, language string, mode string, session_id string")
    store = layers.SavingsStore(records)
    assert store.summary().first().tokens_saved == 60
    assert all(getattr(store, n)().count() == 1 for n in ("daily", "by_command", "by_language", "by_mode", "top_commands", "sessions"))


def test_invariants(spark):
    known = layers.Invariants()
    known.register("same_start", lambda a, b: F.substring(a, 1, 1) == F.substring(b, 1, 1))
    with pytest.raises(ValueError):
        known.register("same_start", lambda a, b: F.lit(True))
    df = spark.createDataFrame([("abc",), ("xbc",), (None,)], "t string")
    got = known.apply(df, "t", lambda c: F.replace(c, F.lit("x"), F.lit(""))).collect()
    assert [(r.out, r.accepted) for r in got] == [("abc", True), ("xbc", False), (None, True)]


def test_log_tiers(spark):
    docs = [
        (1, '{"level":"info","msg":"a"}\nnot json\n{"lvl":"debug","text":"b"}\n{"level":"info","msg":"A"}'),
        (2, "2024-01-02T03:04:05Z ERROR: boom\n  at a\n  at b\n  at c\n  at d\n\nERROR: boom"),
        (3, "plain words\nand more"), (4, None), (5, ""), (6, "  File \"x.py\", line 1\nfoo"), (7, "WARN: x\n  at only\nWARN: y"),
    ]
    df = spark.createDataFrame(docs, "doc_id int, text string")
    got = {}
    for r in lg.compress(df).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append((r.tier, r.level, r.message, r["count"]))
    assert got[1] == [("full", "INFO", "a", 2), ("full", None, "not json", 1)]
    assert got[2] == [("degraded", "ERROR", "boom\nat b\nat c\nat d", 1), ("degraded", "ERROR", "boom", 1)]
    assert got[3] == [("passthrough", None, "plain words\nand more", 1)] and 4 not in got and got[5][0][0] == "passthrough"
    assert got[6] == [("degraded", None, "foo", 1)]
    kept = {r.doc_id: r.tier for r in lg.compress(df, lossless=True).collect()}
    assert kept == {1: "passthrough", 2: "passthrough", 3: "passthrough", 5: "passthrough", 6: "degraded", 7: "degraded"}


def test_raw_equality_and_codec(spark):
    assert jt.equal_raw('{"a":1,"b":[2]}', '{ "b":[2], "a":1 }') and not jt.equal_raw("[1.0]", "[1]") and not jt.equal_raw("[1e2]", "[1E2]")
    assert jt.equal_raw(None, "1") is None and not jt.equal_raw('{"a":1,"a":1}', '{"a":1}') and not jt.equal_raw("[1", "[1")
    assert not jt.equal_raw(json.dumps({str(i): i for i in range(50)}), json.dumps({str(i): i for i in range(50)}), work=10)
    texts = ["[[0,3,7],[3,9,1]]", "[]", "[[1,2]]", "[[5,2,1]]", "no", None]
    got = [None if r.m is None else [tuple(x) for x in r.m] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(serde.decode_field_map(F.col("t")).alias("m")).collect()]
    assert got == [[(0, 3, 7), (3, 9, 1)], [], None, None, None, None]
    lines = spark.createDataFrame([([4, 2, 9],), ([],), (None,)], "l array<int>").select(tx.line_range(F.col("l")).alias("r")).collect()
    assert [tuple(r.r) for r in lines] == [(2, 10), (0, 0), (0, 0)]


def test_command_classes(spark):
    rules = [("cargo test", "run test", ()), ("ls", "list", ("-a",))]
    commands = ["cargo test && ls -l | head", "run x", "run x; make", "ls -a", "", None, "own x", "echo `ls`", "ls  -l", "ls -l 2>/dev/null || true"]
    df = spark.createDataFrame(list(enumerate(commands)), "cmd_id int, command string")
    got = {r.cmd_id: (r.kind, r.rewritten) for r in parsers.classify_commands(df, rules, ("run",), ("own",)).collect()}
    no = ("unhandled", None)
    assert got == {0: ("rewritten", "run test && list -l | head"), 1: ("already_compact", None), 2: no, 3: no, 4: no, 5: no, 6: no, 7: no, 8: no, 9: ("rewritten", "list -l 2>/dev/null || true")}


def test_tree_by_globs_and_ignore_rules(spark, tmp_path):
    for name in ("a.py", "src/b.py", "src/gen/c.py", "src/gen/keep.py", "logs/d.txt", "deep/logs/e.py", ".hidden/f.py", "x.min.js"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    names = lambda df: {r.path.split(tmp_path.name + "/", 1)[1] for r in df.collect()}
    root = str(tmp_path)
    assert names(src.read_tree(spark, root)) == {"a.py", "src/b.py", "src/gen/c.py", "src/gen/keep.py", "logs/d.txt", "deep/logs/e.py", "x.min.js"}
    assert names(src.read_tree(spark, root, globs=("src/**/*.py",))) == {"src/b.py", "src/gen/c.py", "src/gen/keep.py"}
    rules = ("# comment", "", "logs/", "/src/gen", "!src/gen/keep.py", "*.min.js")
    assert names(src.read_tree(spark, root, ignore=rules)) == {"a.py", "src/b.py", "src/gen/keep.py"}
