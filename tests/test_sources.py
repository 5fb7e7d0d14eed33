import json

import pytest
from pyspark.sql import functions as F

from brindle.functions import serde, shell
from brindle.functions import source_modes as sm
from brindle.operators import chat
from brindle.operators import interfaces as itf
from brindle.operators import lexical as lx
from brindle.operators import structural as st
from brindle.sources import history_text as src
from brindle.sources import sinks

TS = """import { a } from "b";
/** doc */
export class Users {
    // note
    async find(id: string, o?: Map<string, X> = 3): Promise<User> {
        if (!o) { throw new E("}"); } // in
        return id;
    }
}
type A = { x: number };
const f = (x: number): number => { return x; };
"""
PY = "#!/usr/bin/env python\n# top\nclass A(B):\n    @property\n    def f(self, x: int = 3, *, y: str) -> int:\n        # in\n        return '# not'\n\n\n\n\n\ndef g(\n    a,\n):\n    pass\n"


def test_modes_of_braces_and_indents():
    assert sm.structure(TS, "typescript").count("{...}") == 2 and "throw" not in sm.structure(TS, "typescript")
    assert sm.signatures(TS, "typescript").split("\n")[0] == "async find(id: string, o?: Map<string, X> = 3): Promise<User>"
    assert sm.types(TS, "typescript").split("\n")[-1] == "type A = { x: number }"
    small = sm.minimal(TS, "typescript")
    assert "/** doc */" in small and "// note" not in small and "// in" in small
    assert "async find(id, o = 3): Promise<User> {" in sm.pseudo(TS, "typescript")
    assert sm.structure(PY, "python") == "#!/usr/bin/env python\n# top\nclass A(B):\n    @property\n    def f(self, x: int = 3, *, y: str) -> int: {...}\n\n\n\n\n\ndef g(\n    a,\n): {...}\n"
    assert sm.minimal(PY, "python").startswith("#!/usr/bin/env python\nclass A") and "\n\n\n\n" not in sm.minimal(PY, "python") and "# in" in sm.minimal(PY, "python")
    assert "def f(x = 3, *, y) -> int:" in sm.pseudo(PY, "python") and "@property" not in sm.pseudo(PY, "python")
    assert sm.symbols(TS, "typescript")[:2] == [("Users", "type_definition"), ("find", "function_signature")]
    assert sm.structure("class A\n  def f(x)\n    1\n  end\nend\n", "ruby") == "class A\n  def f(x) {...}\nend\n"
    assert sm.types("CREATE TABLE a (x int);\nSELECT 1;", "sql") == "CREATE TABLE a (x int);"


@pytest.mark.parametrize("mode", ["full", "minimal", "pseudo", "structure", "signatures", "types"])
@pytest.mark.parametrize("lang", [*sm.BRACES, "python", "ruby", "sql", "markdown", "json", "yaml", "toml", None])
def test_modes_never_fail(mode, lang):
    for text in ("", "{", "}}}", '"', "def f(", "/* open", "a: [", "\u00e9{\n" * 50, "\x00"):
        assert isinstance(sm.transform(text, lang, mode), str)
    assert sm.transform(None, lang, mode) is None


def test_headings_and_serde():
    text = "Title\n=====\ntext\n\n```\n# no\n```\n## Two\n#### Four\n- item\n---\n"
    assert sm.headings(text, 3) == [(1, "# Title"), (2, "## Two")] and len(sm.headings(text, 6)) == 3
    assert serde.yaml_structure("a:\n  b: 1\n  c: [{d: 1}]\n---\ne: 2\n") == "a:\n  b\n  c:\n    d\n---\ne"
    assert serde.toml_structure("[a]\nb=1\n") == "a:\n  b" and serde.toml_structure("x") == "x" and serde.yaml_structure("a: [") == "a: ["


@pytest.mark.parametrize("lang", ["json", "yaml", "toml", "markdown", "python", "rust", "sql", None])
def test_field_maps_cover_every_byte(lang):
    for text in ('{"k": {"é": "ü"}}', "k: é # c\n", '[a]\nb = "é"\n', "# é\n[l]: u\n", "def é():\n    pass\n", "fn f() { /* é */ }"):
        spans = serde.field_map(text, lang)
        assert spans[0][0] == 0 and spans[-1][1] == len(text.encode()) and all(a[1] == b[0] and a[2] != b[2] for a, b in zip(spans, spans[1:], strict=False))
    assert serde.field_map("", lang) == []


def test_compound_commands():
    assert shell.split_compound("a 'x && y' && b || c; d | e 2>&1") == [("a 'x && y'", "&&", []), ("b", "||", []), ("c", ";", []), ("d", "|", []), ("e", None, ["2>&1"])]
    assert shell.split_compound("(a && b); c") == [("(a && b)", ";", []), ("c", None, [])]
    assert [shell.split_compound(x) for x in ("echo `x`", "a $(b)", "cat << E", None)] == [None] * 4 and shell.split_compound("") == []
    assert shell.split_compound("echo '$(x)' && 'open") == [("echo '$(x)'", "&&", []), ("'open", None, [])]


def test_chat_bodies(spark):
    wide = json.dumps({"a": [1, 2, 3]}, indent=20)
    bodies = [
        json.dumps({"model": "gpt-4", "messages": [{"role": "user", "content": "hi"}, {"role": "user", "content": None}]}),
        json.dumps({"max_tokens": 1, "messages": [{"role": "user", "content": [{"type": "text", "text": wide}, {"type": "image"}, {"type": "tool_result", "content": f"see\n```json\n{wide}\n```\nend"}]}]}),
        json.dumps({"messages": [{"role": "user", "content": "[1, 2] is a list"}]}), "not json", None, "{}",
    ]
    df = spark.createDataFrame(list(enumerate(bodies)), "request_id int, body string")
    assert [r.p for r in df.orderBy("request_id").select(chat.provider(F.col("body")).alias("p")).collect()] == ["openai", "anthropic", "anthropic", None, None, None]
    rows = {(r.request_id, r.block_no): r for r in chat.route(chat.text_blocks(df)).collect()}
    assert set(rows) == {(0, 0), (1, 0), (1, 1), (2, 0)} and rows[1, 0].text_out == '{"a":[1,2,3]}'
    assert rows[1, 1].text_out == 'see\n```json\n{"a":[1,2,3]}\n```\nend' and rows[2, 0].text_out == "[1, 2] is a list" and rows[0, 0].reason == "no_engine"
    assert chat.reduce_log("2024-01-02 03:04:05 a\n2024-01-02 03:04:07 a\nb\n2024-01-02 03:04:09 a\nERROR: x\nWARN: x\nWARN: x") == "2024-01-02 03:04:05 a (x2, last 2024-01-02 03:04:07)\nb\n2024-01-02 03:04:09 a\nERROR: x\nWARN: x (x2)"


def test_markers(spark):
    nodes = [(1, 0, "function_item", 0), (1, 1, "parameters", 1), (1, 2, "block", 1), (1, 3, "if_expression", 2), (1, 4, "block", 3), (1, 5, "{", 4), (1, 6, "line_comment", 4), (2, 0, "catch_clause", 0), (2, 1, "block", 1)]
    grams, metrics = st.markers(spark.createDataFrame(nodes, "doc_id bigint, ord int, kind string, depth int"))
    assert {(r.doc_id, r.p, r.c, r["count"]) for r in grams.collect()} == {(1, "__empty_body__", "if_expression", 1), (1, "__deep_node__", "__deep_node_b4__", 2), (2, "__empty_body__", "catch_clause", 1)}
    assert {tuple(r) for r in metrics.collect()} == {(1, 4, 1, 0, 1), (2, 1, 0, 0, 1)}  # a catch clause is a branch


def test_sinks(spark, tmp_path):
    p = str(tmp_path)
    files = spark.createDataFrame([(1, "abab", "rust"), (2, "fn é() { 1 }", "rust"), (3, "fn é() { 1 }", "rust")], "doc_id int, content string, lang string")
    index = sinks.write_lexical_index(files, p)
    assert [(r.doc_id, r.tf_7) for r in index.terms(["6162"]).collect()] == [(1, 2)] and index.read("corpus_stats").first().n_files == 3
    assert lx.term_frequency(lx.postings(files)).count() == index.read("terms").count()
    rec = spark.createDataFrame([("é" * 300, "bad id!"), ("x", "ok")], "original_cmd string, session_id string")
    for _ in range(2):
        sinks.record_savings(rec, f"{p}/savings")
    got = spark.read.parquet(f"{p}/savings").collect()
    assert sorted((len(r.original_cmd), r.session_id or "") for r in got) == [(1, "ok"), (1, "ok"), (250, ""), (250, "")]
    cuts = spark.createDataFrame([("ab\u20acd",), ("\U0001f600x",), ("",), (None,)], "t string").select(sinks.cut_bytes(F.col("t"), 4).alias("a"), sinks.cut_bytes(F.col("t"), 3).alias("b")).collect()
    assert [(r.a, r.b) for r in cuts] == [("ab", "ab"), ("\U0001f600", ""), ("", ""), (None, None)]
    with pytest.raises(ValueError):
        sinks.write_history({"hotspot": spark.range(5)}, p, most=4)
    sinks.write_history({"hotspot": spark.range(5)}, p)
    sinks.write_cochange(spark.createDataFrame([("a", "b", 1)], "file_a string, file_b string, count int"), p)
    sinks.tee_failures(spark.createDataFrame([("x", 0), ("y", 2)], "text string, exit_code int"), f"{p}/raw")
    assert spark.read.parquet(f"{p}/raw").count() == 1
    assert json.loads(sinks.as_json(spark.createDataFrame([(1, None)], "a int, b string")).first().json) == {"a": 1, "b": None}
    (tmp_path / "cache").mkdir()
    for _ in range(2):
        assert {r.doc_id: r.output for r in sinks.cached_transform(files, f"{p}/cache", "structure").collect()} == {1: "abab", 2: "fn é() {...}", 3: "fn é() {...}"}
    assert spark.read.parquet(f"{p}/cache").count() == 2


def test_other_transcripts(spark):
    lines = lambda *objs: spark.createDataFrame([("s", n, o if isinstance(o, str) else json.dumps(o)) for n, o in enumerate(objs)], "session_id string, line_no int, line string")
    pick = lambda df: [(r.seq, r.tool, r.command, r.is_error, r.result) for r in df.orderBy("seq").collect()]
    cop = lines({"type": "tool_use", "id": "1", "toolName": "bash", "toolArgs": {"command": "ls"}}, "{bad", {"type": "tool_use", "id": "2", "toolName": "view", "toolArgs": {"path": "/a"}}, {"type": "tool_result", "toolUseId": "1", "content": "no", "resultType": "error"}, {"type": "tool_result", "toolUseId": "9", "content": "x"})
    assert pick(src.parse_flat_sessions(cop, "copilot")) == [(1, "bash", "ls", True, "no"), (2, "view", "/a", None, None)]
    call = {"id": "c", "type": "function", "function": {"name": "run", "arguments": json.dumps({"command": "make"})}}
    blob = json.dumps({"composerData": {"conversations": [{"messages": [{"role": "assistant", "tool_calls": [call]}, {"role": "tool", "tool_call_id": "c", "content": "ok"}]}]}})
    assert pick(src.parse_nested_sessions(spark.createDataFrame([("s", blob), ("t", "{}"), ("u", None)], "session_id string, value string"))) == [(1, "run", "make", None, "ok")]
    flat = [{"type": "tool_use", "tool": "sh", "args": {"command": "a"}, "id": "1"}, {"type": "tool_result", "tool_use_id": "1", "content": "r", "is_error": False}]
    whole = spark.createDataFrame([("a", json.dumps(flat)), ("b", "\n".join(map(json.dumps, flat)) + "\n"), ("c", "")], "session_id string, text string")
    got = {(r.session_id, r.command, r.result) for r in src.parse_sessions(src.lines_or_array(whole)).collect()}
    assert got == {("a", "a", "r"), ("b", "a", "r")}


def test_contract(spark):
    df = spark.createDataFrame([("aa  b",), ("x",), (None,)], "t string")
    rows = itf.apply_contract(df, "t", lambda c: F.regexp_replace(c, "^x$", "longer"), [lambda a, b: b.isNotNull()]).collect()
    assert [(r.out, r.accepted) for r in rows] == [("aa  b", True), ("x", False), (None, True)]
