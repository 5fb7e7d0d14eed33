from pyspark.sql import functions as F

from brindle.functions import parsers as p
from brindle.operators import truncation as tr


def _lines(spark, text):
    return p.to_lines(spark.createDataFrame([(1, text)], "doc_id int, text string"))


def test_tests_builds_and_lint(spark):
    outs = spark.createDataFrame([(1, "== 3 passed, 2 failed, 1 skipped in 0.50s =="), (2, "test result: 4 passed"), (3, "hello"), (4, None)], "doc_id int, text string")
    got = {r.doc_id: (r.passed, r.failed, r.skipped, r.duration_s, r.tier) for r in p.test_summary(outs).collect()}
    assert got[1] == (3, 2, 1, 0.5, "full") and got[2] == (4, 0, 0, None, "degraded") and got[3][4] == got[4][4] == "passthrough"
    names = _lines(spark, "test a::b ... FAILED\nFAILED t.py::x - boom\nt.py::y FAILED [ 9%]\nt.py::z PASSED")
    assert {r.name for r in p.failing_tests(names).collect()} == {"a::b", "t.py::x", "t.py::y"}
    b = p.build_summary(_lines(spark, "warning: unused\nerror[E0308]: mismatched\nsrc/x.c:3: error: bad\nok")).first()
    assert (b.errors, b.warnings, b.success, b.first_error) == (2, 1, False, "error[E0308]: mismatched")
    i = p.lint_issues(_lines(spark, "a.py:3:1: error: bad name [name-defined]\nb.py:9: note: see\nnoise")).collect()
    assert [(r.file, r.line, r.severity, r.rule) for r in i] == [("a.py", 3, "error", "name-defined"), ("b.py", 9, "info", "unknown")]


def test_history_outputs(spark):
    s = p.status_summary(_lines(spark, "# branch.head main\n# branch.ab +2 -1\n1 M. N... a\n1 .M N... b\n2 RM N... c\n? d\nu UU x")).first()
    assert (s.branch, s.ahead, s.behind, s.staged, s.unstaged, s.untracked, s.conflicts) == ("main", 2, 1, 2, 2, 1, 1)
    assert [(r.hash, r.subject) for r in p.log_subjects(_lines(spark, "abcdef1 (HEAD) fix\nnot one\n1234567 add")).collect()] == [("abcdef1", "fix"), ("1234567", "add")]
    diff = "diff --git a/f b/f\n--- a/f\n+++ b/f\n@@ -1,3 +1,4 @@\n a\n-b\n+c\n+d\n e\n@@ -9 +10 @@\n-x\n+y"
    assert [(r.mark, r.new_line) for r in p.diff_lines(_lines(spark, diff)).orderBy("pos").collect()] == [(" ", 1), ("-", 2), ("+", 2), ("+", 3), (" ", 4), ("-", 10), ("+", 10)]


def test_tables_rewrites_and_paths(spark):
    t = p.table_rows(spark.createDataFrame([(1, " id | name\n----+-----\n  1 | a\n  2 | b\n(2 rows)"), (2, "")], "doc_id int, text string")).collect()
    assert t[0].columns == ["id", "name"] and t[0].rows == [["1", "a"], ["2", "b"]] and t[1].columns == []
    cmds = spark.createDataFrame([(1, "A=1 cargo test -q"), (2, "cargo build --json"), (3, "ls"), (4, "cargo  test")], "cmd_id int, command string")
    got = {r.cmd_id: r.rewritten for r in p.match_rewrites(cmds, [("cargo test", "x test", ()), ("cargo build", "x build", ("--json",))]).collect()}
    assert got == {1: "A=1 x test -q", 2: None, 3: None, 4: "x test"}
    paths = spark.createDataFrame([("a/Cargo.lock",), ("node_modules/x.js",), ("src\\dist\\y.c",), ("x.min.js",), ("src/dist",), ("src/main.rs",)], "path string")
    assert [r.d for r in paths.select(p.is_denied(F.col("path")).alias("d")).collect()] == [True, True, True, True, False, False]


def test_budgets(spark):
    df = spark.createDataFrame([(1, "aaaa\nbbbb\ncccc\n" + "d" * 60), (2, "short")], "doc_id bigint, text string")
    got = {r.doc_id: r.t for r in df.select("doc_id", tr.to_token_budget(F.col("text"), 9).alias("t")).collect()}
    assert got == {1: "aaaa\nbbbb\n... (truncated)", 2: "short"}
    modes = spark.createDataFrame([(1, "full", "f", 90), (1, "types", "t", 5), (1, "structure", "s", 20), (2, "full", "f", 90), (2, "types", "t", 50)], "doc_id bigint, mode string, text string, tokens int")
    assert {r.doc_id: r.mode for r in tr.cascade(modes, 25).collect()} == {1: "structure", 2: "types"}
    assert tr.by_priority(list("abcdef"), [(0, 1, 3), (2, 4, 5), (5, 6, 1)], 5) == ["a", "... (1 lines omitted)", "c", "d", "... (2 lines omitted)"]
    spans = "array<struct<start:int,end:int,priority:int>>"
    docs = spark.createDataFrame([(1, "a\nb\nc\nd", [(1, 2, 5)]), (2, None, None)], f"doc_id bigint, text string, spans {spans}")
    assert {r.doc_id: r.text for r in tr.truncate_by_priority(docs, 3).collect()} == {1: "... (1 lines omitted)\nb\n... (2 lines omitted)", 2: ""}
