"""Registered queries of tool outputs, source modes, commands, chat bodies and markers with their DuckDB equivalents. Inputs are spelt
from the events table, whose numbers the equivalents then expect."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import parsers, serde, shell
from brindle.functions import source_modes as sm
from brindle.functions import tool_outputs as to
from brindle.operators import chat
from brindle.operators import evaluation as ev
from brindle.operators import structural as st
from brindle.plans.views import table, touches, with_views
from brindle.sources import history_text as src
from brindle.sources import sinks


def _texts(sp, d, tools: list[str], forms: list[str]):
    """doc_id, tool, text: one form (SQL over ``i`` = event_id and ``t`` = event_type) after another."""
    case = " ".join(f"WHEN {n} THEN {f}" for n, f in enumerate(forms))
    names = " ".join(f"WHEN {n} THEN '{t}'" for n, t in enumerate(tools))
    e = table(sp, d, "events").selectExpr("event_id AS i", "event_type AS t")
    return e.selectExpr("i AS doc_id", f"CASE i % {len(forms)} {names} END AS tool", f"CASE i % {len(forms)} {case} END AS text")


_TESTS = (
    ["go", "vitest", "playwright", "dotnet", "nextest", "pytest"],
    [
        r"""concat(repeat('{"Action":"pass","Test":"a"}\n', cast(i % 7 as int)), repeat('{"Action":"fail","Test":"b"}\n', cast(i % 3 as int)), '{"Action":"skip","Test":"c"}')""",
        """concat('{"numTotalTests":9,"numPassedTests":', i % 7, ',"numFailedTests":', i % 3, ',"numPendingTests":1}')""",
        """concat('{"stats":{"expected":', i % 7, ',"unexpected":', i % 3, ',"skipped":1,"duration":5}}')""",
        """concat('<Counters total="9" passed="', i % 7, '" failed="', i % 3, '" notExecuted="1" />')""",
        """concat(' Summary [ 2.000s] 9 tests run: ', i % 7, ' passed, ', i % 3, ' failed, 1 skipped')""",
        """concat('== ', i % 7, ' passed, ', i % 3, ' failed, 1 skipped in 2.0s ==')""",
    ],
)
_ISSUES = (
    ["eslint", "ruff", "mypy", "gofmt", "biome"],
    [
        """concat('[{"filePath":"', t, '.js","messages":[{"ruleId":"r', i % 5, '","severity":', 1 + i % 2, ',"message":"m","line":', i % 90, '}]}]')""",
        """concat('[{"filename":"', t, '.py","code":"F', i % 5, '","message":"m","location":{"row":', i % 90, '}}]')""",
        """concat(t, '.py:', i % 90, ': error: m  [r', i % 5, ']')""",
        r"""concat(t, '.go\nsub/', t, '.go')""",
        """concat('{"diagnostics":[{"category":"c', i % 5, '","severity":"warning","description":"m","location":{"path":{"file":"', t, '.ts"}}}]}')""",
    ],
)
_BUILDS = (
    ["cargo", "tsc", "gradle", "make"],
    [
        r"""concat(repeat('{"reason":"compiler-message","message":{"level":"error"}}\n', cast(i % 3 as int)), '{"reason":"compiler-message","message":{"level":"warning"}}')""",
        r"""repeat('a.ts(1,2): error TS2322: bad\n', cast(i % 3 as int))""",
        r"""concat('w: note\n', if(i % 3 = 0, 'BUILD SUCCESSFUL in 2s', 'e: bad\nBUILD FAILED in 1m 2s'))""",
        r"""concat('a.c:1:2: warning: w\n', repeat('a.c:1:2: error: bad\n', cast(i % 3 as int)))""",
    ],
)
_PACKAGES = (
    ["npm", "npm", "yarn", "pip", "npm"],
    [
        """concat('added ', i % 40, ' packages, removed ', i % 4, ' packages in 2s')""",
        """concat('{"metadata":{"vulnerabilities":{"low":', i % 6, ',"moderate":0,"high":', i % 3, ',"critical":1}}}')""",
        r"""concat('{"type":"info","data":{}}\n{"type":"auditSummary","data":{"vulnerabilities":{"low":', i % 6, ',"high":', i % 3, '}}}')""",
        """concat('Successfully installed ', t, '-1', repeat(' x-2', cast(i % 4 as int)))""",
        """concat('{"', t, '":{"current":"1","latest":"2"},"y":{"current":"1"}}')""",
    ],
)
_INFRA = (
    ["aws", "docker", "terraform", "kubectl"],
    ["""concat('{"Name":"', t, '","Size":', i % 9, '}')""", r"""concat('{"ID":"', t, '"}\n{"ID":"', i, '"}')""", """concat('Plan: ', i % 9, ' to add, 0 to change, ', i % 4, ' to destroy.')""", r"""concat('NAME     READY\n', t, '     ', i % 9, '/9')"""],
)
_DB = (["psql", "mysql", "sqlite3"], [r"""concat(' id | n\n----+----\n ', i, ' | ', t, '\n(1 row)')""", r"""concat('id\tn\n', i, '\t', t)""", r"""concat('id|n\n', i, '|', t)"""])
_VCS = (
    ["commit", "push", "fetch"],
    [
        r"""concat('[main ', lpad(lower(hex(i)), 8, '0'), '] ', t, '\n ', 1 + i % 4, ' files changed, ', i % 9, ' insertions(+), 2 deletions(-)')""",
        r"""concat(repeat(' \trefs/heads/a:refs/heads/a\tok\n', cast(i % 4 as int)), '!\trefs/heads/b:refs/heads/b\t[rejected]')""",
        r"""concat('From x\n', repeat('   abc1234..def5678  main -> origin/main\n', cast(i % 4 as int)), ' * [new branch]      b -> origin/b')""",
    ],
)
_FILES = (["tree", "ls", "wc"], [r"""concat('.\n|-- a\n\n', i % 9, ' directories, ', i % 50, ' files')""", r"""concat('total 8\n', repeat('drwxr-xr-x 2 r r 1 a\n', cast(i % 4 as int)), '-rw-r--r-- 1 r r 1 b')""", """concat(i, ' a')"""])

_RUST = r"""concat('use std::', t, ';\n// note\n#[derive(Debug)]\npub struct S', i, ' { x: u8 }\npub fn ', t, '_', i, '(x: u8) -> u8 {\n    // kept\n    x + ', i % 7, '\n}\n')"""
_PY = r"""concat('import ', t, '\n# note\nclass C', i, ':\n    def ', t, '(self, x: int = ', i % 7, ') -> int:\n        return x\n')"""
_MD = r"""concat('# ', t, '\ntext\n```\n# no\n```\n## Two ', i % 7, '\n#### Four\n')"""
_YAML = r"""concat(t, ':\n  a: ', i, '\n  b:\n    - c: 1\n    - d: 2\n---\ne: [1]\n')"""
_TOML = r"""concat('[', t, ']\na = ', i, '\n[[b]]\nc = 1\n')"""
_SOURCES = (["rust", "python", "markdown", "yaml", "toml"], [_RUST, _PY, _MD, _YAML, _TOML])


def _mode(mode: str):
    return lambda sp, d: _texts(sp, d, *_SOURCES).select("doc_id", sm.transform_column(F.col("text"), F.col("tool"), mode).alias("out"))


def _fields(sp, d):
    rows = _texts(sp, d, ["json", "toml", "markdown"], ["""concat('{"', t, '":{"k":"', i, '"}}')""", r"""concat('[', t, ']\nk = "', i, '"')""", r"""concat('# ', t, '\n', i)"""])
    return rows.select("doc_id", F.explode(serde.field_map_column(F.col("text"), F.col("tool"))).alias("r")).select("doc_id", "r.*")


def _compound(sp, d):
    rows = _texts(sp, d, ["a", "b", "c"], ["""concat('cd ', t, ' && make "a && b" ', i, ' 2>/dev/null | tail')""", """concat('(a; b) || ', t)""", """concat('echo $(', t, ')')"""])
    return rows.select("doc_id", shell.split_column(F.col("text")).alias("s")).select("doc_id", F.col("s").isNull().alias("bail"), F.posexplode_outer("s").alias("pos", "p")).select("doc_id", "bail", "pos", "p.command", "p.operator", F.size("p.redirects").alias("redirects"))


def _bodies(sp, d):
    rows = _texts(sp, d, ["x", "y", "z"], [
        """concat('{"model":"gpt-4o","messages":[{"role":"user","content":"hello ', t, '"}]}')""",
        """concat('{"max_tokens":5,"messages":[{"role":"user","content":[{"type":"text","text":"{', repeat(' ', 80), '\\\\"a\\\\": ', i, '}"}]}]}')""",
        """concat('{"model":"o3-x","messages":[{"role":"tool","tool_call_id":"1","content":"', '[INFO] same ', t, repeat('\\\\n[INFO] again and again and again', 4), '"}]}')""",
    ])
    return rows.select(F.col("doc_id").alias("request_id"), F.col("text").alias("body"))


def _transcript(sp, d):
    """A call an event and, but for every third, its result."""
    e = table(sp, d, "events").selectExpr("event_id AS i", "event_type AS t")
    call = """concat('{"type":"codex.tool_decision","tool":"shell","tool_decision_id":"', i, '","args":{"command":"run ', t, '"}}')"""
    done = """concat('{"type":"codex.tool_result","tool_decision_id":"', i, '","result":{"content":"out ', i, '","is_error":', i % 3 = 1, '}}')"""
    rows = e.selectExpr("concat('s', i % 20) AS session_id", "i * 2 AS line_no", f"{call} AS line").unionByName(e.filter("i % 3 > 0").selectExpr("concat('s', i % 20) AS session_id", "i * 2 + 1 AS line_no", f"{done} AS line"))
    return rows


def _nodes(sp, d):
    """One callable an event, with event_id % 14 parameters and event_id % 45 statements, every ninth of them a branch."""
    i = F.col("event_id")
    row = lambda k, depth: F.struct(k.alias("kind"), depth.alias("depth"))
    lit = lambda k, n: F.array(row(F.lit(k), F.lit(n)))
    many = lambda n, k: F.transform(F.filter(F.sequence(F.lit(0), n.cast("int")), lambda x: x > 0), lambda x: row(k(x), F.lit(2)))
    kinds = F.concat(lit("function_item", 0), lit("parameters", 1), many(i % 14, lambda x: F.lit("identifier")), lit(",", 2), lit("block", 1), many(i % 45, lambda x: F.when(x % 9 == 0, "if_expression").otherwise("let_declaration")))
    return table(sp, d, "events").select(i.alias("doc_id"), F.posexplode(kinds).alias("ord", "n")).select("doc_id", "ord", "n.kind", "n.depth")


QUERIES = {
    "parse_test_results": lambda sp, d: to.test_results(_texts(sp, d, *_TESTS)),
    "parse_tool_issues": lambda sp, d: to.tool_issues(_texts(sp, d, *_ISSUES)),
    "parse_build_results": lambda sp, d: to.build_results(_texts(sp, d, *_BUILDS)),
    "parse_package_results": lambda sp, d: to.package_results(_texts(sp, d, *_PACKAGES)),
    "parse_infra_items": lambda sp, d: to.infra_items(_texts(sp, d, *_INFRA)),
    "parse_db_rows": lambda sp, d: to.db_rows(_texts(sp, d, *_DB)).select("doc_id", F.array_join("columns", ",").alias("columns"), F.array_join(F.flatten("rows"), ",").alias("cells")),
    "parse_vcs_results": lambda sp, d: to.vcs_results(_texts(sp, d, *_VCS)),
    "parse_file_results": lambda sp, d: to.file_results(_texts(sp, d, *_FILES)).drop("text"),
    **{f"source_{m}": _mode(m) for m in ("structure", "signatures", "types", "minimal", "pseudo")},
    "source_field_map": _fields,
    "split_compound": _compound,
    "chat_provider": lambda sp, d: _bodies(sp, d).select("request_id", chat.provider(F.col("body")).alias("provider")),
    "chat_route": lambda sp, d: chat.route(chat.text_blocks(_bodies(sp, d))).select("request_id", "message_no", "block_no", "content_class", "engine", "outcome", "reason", "bytes_in", "bytes_out"),
    "structural_markers": lambda sp, d: st.markers(_nodes(sp, d))[0].drop("gp"),
    "structural_metrics": lambda sp, d: st.markers(_nodes(sp, d))[1],
    "session_codex": lambda sp, d: src.parse_flat_sessions(_transcript(sp, d), "codex"),
    "eval_qrels": lambda sp, d: ev.generate_qrels(table(sp, d, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(0).alias("pos"), F.concat("p_brand", F.lit("_"), (F.col("p_partkey") % 97).cast("string")).alias("name"), F.element_at(F.array(*map(F.lit, ev.QUOTAS)), (F.col("p_partkey") % 4 + 1).cast("int")).alias("field"))),
    "history_excludes": lambda sp, d: touches(sp, d).select("path").distinct().select("path", parsers.is_excluded(F.concat(F.lit("dist/"), F.col("path"))).alias("dist"), parsers.is_excluded(F.concat(F.col("path"), F.lit("/a.lock"))).alias("lock"), parsers.is_excluded(F.col("path")).alias("plain")),
    "index_manifest": lambda sp, d: sinks.manifest(table(sp, d, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"), "lang")),
    "savings_cut_command": lambda sp, d: table(sp, d, "documents").select("doc_id", sinks.cut_bytes(F.col("text"), 500).alias("cut")).select("doc_id", F.octet_length("cut").alias("n"), F.sha2("cut", 256).alias("sha256")),
}

_E = "WITH e AS (SELECT event_id AS i, event_type AS t FROM events) "


def _pick(n: int, values: list[str]) -> str:
    return f"CASE i % {n} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


def _tool(family) -> str:
    return _pick(len(family[0]), [f"'{t}'" for t in family[0]])


_NL = "chr(10)"
_STRUCT = "'pub struct S' || i || ' { x: u8 }'"
_SIG = "'pub fn ' || t || '_' || i || '(x: u8) -> u8'"
_PYSIG = "'def ' || t || '(self, x: int = ' || (i % 7) || ') -> int'"
_HEADS = f"'# ' || t || {_NL} || '## Two ' || (i % 7)"
_YKEYS = f"t || ':' || {_NL} || '  a' || {_NL} || '  b:' || {_NL} || '    c' || {_NL} || '---' || {_NL} || 'e:'"
_TKEYS = f"t || ':' || {_NL} || '  a' || {_NL} || 'b:' || {_NL} || '  c'"
_YRAW = f"t || ':' || {_NL} || '  a: ' || i || {_NL} || '  b:' || {_NL} || '    - c: 1' || {_NL} || '    - d: 2' || {_NL} || '---' || {_NL} || 'e: [1]' || {_NL}"
_TRAW = f"'[' || t || ']' || {_NL} || 'a = ' || i || {_NL} || '[[b]]' || {_NL} || 'c = 1' || {_NL}"
_MRAW = f"'# ' || t || {_NL} || 'text' || {_NL} || '```' || {_NL} || '# no' || {_NL} || '```' || {_NL} || '## Two ' || (i % 7) || {_NL} || '#### Four' || {_NL}"
_RBODY = f"{_NL} || '    // kept' || {_NL} || '    x + ' || (i % 7) || {_NL} || '}}' || {_NL}"
_MODES = {
    "structure": [f"'use std::' || t || ';' || {_NL} || '// note' || {_NL} || '#[derive(Debug)]' || {_NL} || {_STRUCT} || {_NL} || {_SIG} || ' {{...}}' || {_NL}".replace("{{", "{").replace("}}", "}"), f"'import ' || t || {_NL} || '# note' || {_NL} || 'class C' || i || ':' || {_NL} || '    ' || {_PYSIG} || ': {{...}}' || {_NL}".replace("{{", "{").replace("}}", "}"), _HEADS, _YKEYS, _TKEYS],
    "signatures": [_SIG, _PYSIG, f"{_HEADS} || {_NL} || '#### Four'", _YKEYS, _TKEYS],
    "types": [f"'#[derive(Debug)]' || {_NL} || {_STRUCT}", f"'class C' || i || ':' || {_NL} || '    ' || {_PYSIG} || ': ' || '{{...}}'".replace("{{", "{").replace("}}", "}"), f"{_HEADS} || {_NL} || '#### Four'", _YKEYS, _TKEYS],
    "minimal": [f"'use std::' || t || ';' || {_NL} || '#[derive(Debug)]' || {_NL} || {_STRUCT} || {_NL} || {_SIG} || ' {{' || {_RBODY}".replace("{{", "{").replace("}}", "}"), f"'import ' || t || {_NL} || 'class C' || i || ':' || {_NL} || '    ' || {_PYSIG} || ':' || {_NL} || '        return x' || {_NL}", _MRAW, _YRAW, _TRAW],
    "pseudo": [f"'use std::' || t || {_NL} || {_STRUCT} || {_NL} || {_SIG} || ' {{' || {_RBODY}".replace("{{", "{").replace("}}", "}"), f"'import ' || t || {_NL} || 'class C' || i || ':' || {_NL} || '    def ' || t || '(x = ' || (i % 7) || ') -> int:' || {_NL} || '        return x' || {_NL}", _MRAW, _YRAW, _TRAW],
}

ORACLES = {
    "parse_test_results": _E + f"SELECT i AS doc_id, {_tool(_TESTS)} AS tool, i % 7 AS passed, i % 3 AS failed, 1::BIGINT AS skipped, {_pick(6, ['NULL', 'NULL', '5', 'NULL', '2000', '2000'])}::BIGINT AS duration_ms, 'full' AS tier FROM e",
    "parse_tool_issues": _E + f", r AS (SELECT *, unnest(CASE WHEN i % 5 = 3 THEN [0, 1] ELSE [0] END)::INT AS pos FROM e) SELECT i AS doc_id, {_tool(_ISSUES)} AS tool, pos, CASE WHEN pos = 1 THEN 'sub/' ELSE '' END || t || {_pick(5, [chr(39) + x + chr(39) for x in ('.js', '.py', '.py', '.go', '.ts')])} AS file, CASE WHEN i % 5 < 3 THEN i % 90 END AS line, {_pick(5, ['CASE WHEN i % 2 = 1 THEN ' + chr(39) + 'error' + chr(39) + ' ELSE ' + chr(39) + 'warning' + chr(39) + ' END', chr(39) + 'error' + chr(39), chr(39) + 'error' + chr(39), chr(39) + 'warning' + chr(39), chr(39) + 'warning' + chr(39)])} AS severity, CASE WHEN i % 5 = 3 THEN 'not formatted' ELSE 'm' END AS message, CASE WHEN i % 5 = 3 THEN 'gofmt/format' ELSE {_pick(5, [chr(39) + x + chr(39) for x in ('r', 'F', 'r', '', 'c')])} || (i % 5) END AS rule FROM r",
    "parse_build_results": _E + f"SELECT i AS doc_id, {_tool(_BUILDS)} AS tool, i % 3 = 0 AS success, CASE WHEN i % 4 = 2 THEN (i % 3 > 0)::BIGINT ELSE i % 3 END AS errors, (i % 4 <> 1)::BIGINT AS warnings, CASE WHEN i % 4 = 2 THEN CASE WHEN i % 3 = 0 THEN 2000 ELSE 62000 END END::BIGINT AS duration_ms FROM e",
    "parse_package_results": _E + f"SELECT i AS doc_id, {_tool(_PACKAGES)} AS tool, CASE i % 5 WHEN 0 THEN i % 40 WHEN 3 THEN 1 + i % 4 END::BIGINT AS added, CASE WHEN i % 5 = 0 THEN i % 4 END::BIGINT AS removed, NULL::BIGINT AS changed, CASE WHEN i % 5 = 4 THEN 1 END::BIGINT AS outdated, CASE WHEN i % 5 = 1 THEN 1 END::BIGINT AS critical, CASE WHEN i % 5 IN (1, 2) THEN i % 3 END::BIGINT AS high, CASE WHEN i % 5 = 1 THEN 0 END::BIGINT AS moderate, CASE WHEN i % 5 IN (1, 2) THEN i % 6 END::BIGINT AS low, NULL::BIGINT AS conflicts, CASE WHEN i % 5 IN (0, 3) THEN 'degraded' ELSE 'full' END AS tier FROM e",
    "parse_infra_items": _E + ", r AS (SELECT i, t, unnest(range(0, CASE WHEN i % 4 = 2 THEN 3 ELSE 2 END))::INT AS pos FROM e) SELECT i AS doc_id, pos, CASE i % 4 WHEN 0 THEN (['Name', 'Size'])[pos + 1] WHEN 1 THEN 'ID' WHEN 2 THEN (['add', 'change', 'destroy'])[pos + 1] ELSE (['name', 'ready'])[pos + 1] END AS label, CASE i % 4 WHEN 0 THEN ([t, (i % 9)::VARCHAR])[pos + 1] WHEN 1 THEN ([t, i::VARCHAR])[pos + 1] WHEN 2 THEN ([(i % 9)::VARCHAR, '0', (i % 4)::VARCHAR])[pos + 1] ELSE ([t, (i % 9) || '/9'])[pos + 1] END AS value, CASE WHEN i % 4 < 2 THEN 'full' ELSE 'degraded' END AS tier FROM r",
    "parse_db_rows": _E + "SELECT i AS doc_id, 'id,n' AS columns, i || ',' || t AS cells FROM e",
    "parse_vcs_results": _E + f"SELECT i AS doc_id, {_tool(_VCS)} AS tool, CASE WHEN i % 3 = 0 THEN 'main' END AS branch, CASE WHEN i % 3 = 0 THEN lower(lpad(to_hex(i), 8, '0')) END AS hash, CASE WHEN i % 3 = 0 THEN t END AS subject, CASE WHEN i % 3 = 0 THEN 1 + i % 4 END::BIGINT AS files, CASE WHEN i % 3 = 0 THEN i % 9 ELSE 0 END::BIGINT AS insertions, CASE WHEN i % 3 = 0 THEN 2 ELSE 0 END::BIGINT AS deletions, CASE i % 3 WHEN 1 THEN i % 4 WHEN 2 THEN i % 4 + 1 ELSE 0 END::BIGINT AS updated, (i % 3 = 1)::BIGINT AS rejected FROM e",
    "parse_file_results": _E + f"SELECT i AS doc_id, {_tool(_FILES)} AS tool, CASE i % 3 WHEN 0 THEN 3 WHEN 1 THEN i % 4 + 1 ELSE 1 END::INT AS entries, CASE i % 3 WHEN 0 THEN i % 9 WHEN 1 THEN i % 4 END::BIGINT AS folders, CASE i % 3 WHEN 0 THEN i % 50 WHEN 1 THEN 1 END::BIGINT AS files FROM e",
    **{f"source_{m}": _E + f"SELECT i AS doc_id, {_pick(5, v)} AS out FROM e" for m, v in _MODES.items()},
    "source_field_map": _E + """, l AS (SELECT i, length(t)::INT AS a, length(i::VARCHAR)::INT AS b FROM e), s AS (SELECT i, unnest(CASE i % 3
        WHEN 0 THEN [[0, 1, 7], [1, a + 3, 0], [a + 3, a + 5, 7], [a + 5, a + 8, 2], [a + 8, a + 9, 7], [a + 9, a + 11 + b, 6], [a + 11 + b, a + 13 + b, 7]]
        WHEN 1 THEN [[0, a + 2, 0], [a + 2, a + 3, 7], [a + 3, a + 4, 2], [a + 4, a + 7, 7], [a + 7, a + 9 + b, 6]]
        ELSE [[0, a + 2, 0], [a + 2, a + 3, 7], [a + 3, a + 3 + b, 5]] END) AS r FROM l) SELECT i AS doc_id, r[1] AS start, r[2] AS "end", r[3] AS field FROM s""",
    "split_compound": _E + """, s AS (SELECT i, unnest(CASE i % 3 WHEN 0 THEN [0, 1, 2] WHEN 1 THEN [0, 1] ELSE [NULL] END)::INT AS pos, t FROM e)
        SELECT i AS doc_id, i % 3 = 2 AS bail, pos, CASE i % 3 WHEN 0 THEN (['cd ' || t, 'make "a && b" ' || i, 'tail'])[pos + 1] WHEN 1 THEN (['(a; b)', t])[pos + 1] END AS command,
        CASE i % 3 WHEN 0 THEN (['&&', '|', NULL])[pos + 1] WHEN 1 THEN (['||', NULL])[pos + 1] END AS operator, CASE WHEN i % 3 = 0 AND pos = 1 THEN 1 WHEN i % 3 < 2 THEN 0 END::INT AS redirects FROM s""",
    "chat_provider": "SELECT event_id AS request_id, CASE WHEN event_id % 3 = 1 THEN 'anthropic' ELSE 'openai' END AS provider FROM events",
    "chat_route": _E + """SELECT i AS request_id, 0 AS message_no, 0 AS block_no, CASE i % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'json' ELSE 'log' END AS content_class, CASE i % 3 WHEN 0 THEN 'passthrough' WHEN 1 THEN 'json' ELSE 'log' END AS engine,
        CASE WHEN i % 3 = 0 THEN 'passthrough' ELSE 'compressed' END AS outcome, CASE WHEN i % 3 = 0 THEN 'no_engine' END AS reason, CASE i % 3 WHEN 0 THEN 6 + length(t) WHEN 1 THEN 87 + length(i::VARCHAR) ELSE 12 + length(t) + 4 * 33 END::INT AS bytes_in,
        CASE i % 3 WHEN 0 THEN 6 + length(t) WHEN 1 THEN 6 + length(i::VARCHAR) ELSE 12 + length(t) + 33 + 5 END::INT AS bytes_out FROM e""",
    "structural_markers": """WITH v AS (SELECT event_id AS i, event_id % 14 AS a, event_id % 45 AS b FROM events), m AS (
        SELECT i, '__empty_body__' AS p, 'function_item' AS c FROM v WHERE b = 0
        UNION ALL SELECT i, '__large_body__', '__large_body_b' || k || '__' FROM v JOIN (VALUES (10), (20), (40)) AS w(k) ON b >= k
        UNION ALL SELECT i, '__many_params__', '__many_params_b' || k || '__' FROM v JOIN (VALUES (5), (8), (12)) AS w(k) ON a >= k)
        SELECT i AS doc_id, p, c, count(*) AS count FROM m GROUP BY ALL""",
    "structural_metrics": "SELECT event_id AS doc_id, 2 AS max_depth, (event_id % 45)::INT AS max_block_stmts, (event_id % 14)::INT AS max_params, (event_id % 45 // 9)::INT AS branch_count FROM events",
    "session_codex": _E + "SELECT 's' || (i % 20) AS session_id, row_number() OVER (PARTITION BY i % 20 ORDER BY i)::INT AS seq, 'shell' AS tool, 'run ' || t AS command, CASE WHEN i % 3 > 0 THEN i % 3 = 1 END AS is_error, CASE WHEN i % 3 > 0 THEN 'out ' || i END AS result FROM e",
    "eval_qrels": """WITH s AS (SELECT p_partkey AS d, p_brand || '_' || (p_partkey % 97) AS name, (['type_definition', 'function_signature', 'import_export', 'symbol_name'])[(p_partkey % 4 + 1)::INT] AS field FROM part),
        f AS (SELECT name, min(d) AS d, min_by(field, d) AS field FROM s GROUP BY name HAVING count(DISTINCT d) <= 5)
        SELECT name AS query, d AS relevant_doc, field FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY d) AS n FROM f) WHERE n <= CASE WHEN field IN ('type_definition', 'function_signature') THEN 15 ELSE 10 END""",
    "history_excludes": with_views(" SELECT DISTINCT path, true AS dist, true AS lock, starts_with(path, 'vendor/') AS plain FROM touches"),
    "index_manifest": "SELECT 'd/' || doc_id AS path, sha256(text) AS sha256, lang, octet_length(encode(text))::INT AS n_bytes FROM documents",
    "savings_cut_command": "WITH c AS (SELECT doc_id, text, coalesce(list_max(list_filter(range(1, least(length(text), 500) + 1), lambda k: octet_length(encode(substr(text, 1, k))) <= 500)), 0) AS k FROM documents) SELECT doc_id, octet_length(encode(substr(text, 1, k)))::INT AS n, sha256(substr(text, 1, k)) AS sha256 FROM c",
}
