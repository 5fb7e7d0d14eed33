"""Registered queries of the log engine, gates, budgets, transcripts, commands, diffs and streams with their DuckDB equivalents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from brindle.functions import json_tools as jt
from brindle.functions import logs as lg
from brindle.functions import parsers as p
from brindle.functions import serde
from brindle.functions import text as tx
from brindle.functions import tool_outputs as to
from brindle.operators import history as h
from brindle.operators import lexical as lx
from brindle.operators import sessions as ss
from brindle.operators import truncation as tr
from brindle.plans.search_queries import files, index
from brindle.plans.views import commits, savings, table, touches, with_views
from brindle.sources import history_text as src
from brindle.sources import scratch
from brindle.streaming import jobs


def _lines(sp, d):
    return table(sp, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))


def _json_lines(sp, d):
    level = F.element_at(F.array(F.lit("info"), F.lit("debug"), F.lit("ERROR")), (F.col("pos") % 3 + 1).cast("int"))
    line = F.when(F.col("pos") % 2 == 0, F.to_json(F.struct(level.alias("level"), F.col("raw").alias("msg")))).otherwise(F.to_json(F.struct(level.alias("lvl"), F.col("raw").alias("text"))))
    return _lines(sp, d).select("doc_id", "pos", line.alias("line"))


def _logs(sp, d):
    """Whole documents as logs: JSON ones, ones with five stack frames at every entry, and plain texts."""
    as_json = F.transform(F.split("text", "\n"), lambda x, i: F.to_json(F.struct(F.when(i % 4 == 3, "debug").otherwise("info").alias("level"), x.alias("msg"))))
    framed = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 6 == 0, F.concat(F.lit("2024-01-02T03:04:"), F.lpad((i % 60).cast("string"), 2, "0"), F.lit("Z ERROR: entry "), x)).otherwise(F.concat(F.lit("    at frame "), i.cast("string"), F.lit(" "), F.substring(x, 1, 0), F.md5(x.cast("binary")))))
    text = F.when(F.col("doc_id") % 3 == 0, F.array_join(as_json, "\n")).when(F.col("doc_id") % 3 == 1, F.array_join(framed, "\n")).otherwise(F.concat(F.lit("no "), F.col("text")))
    return table(sp, d, "documents").select("doc_id", text.alias("text"))


def _compressed(lossless: bool):
    return lambda sp, d: lg.compress(_logs(sp, d), lossless).withColumn("message", F.md5(F.col("message").cast("binary")))


def _diffs(sp, d):
    """A diff an event: one hunk of a context line, event_id % 3 removed and event_id % 4 added lines, and a context line."""
    e = table(sp, d, "events").selectExpr("event_id AS i", "event_type AS t")
    text = r"concat('diff --git a/', t, ' b/', t, '\n--- a/', t, '\n+++ b/', t, '\n@@ -', 1 + i, ',9 +', 5 + i, ',9 @@ fn\n same\n', repeat('-old\n', cast(i % 3 as int)), repeat('+new\n', cast(i % 4 as int)), ' end')"
    return p.to_lines(e.selectExpr("i AS doc_id", f"{text} AS text"))


def _status(sp, d):
    """Lines of a porcelain status and of a one-line history, by event."""
    text = r"concat('# branch.head ', t, '\n# branch.ab +', i % 5, ' -', i % 3, '\n1 M. N... 1 1 1 a b x\n', repeat('1 .M N... 1 1 1 a b y\n', cast(i % 4 as int)), repeat('? z\n', cast(i % 3 as int)), lpad(lower(hex(i)), 9, 'a'), ' ', t, ' subject')"
    return p.to_lines(table(sp, d, "events").selectExpr("event_id AS i", "event_type AS t").selectExpr("i AS doc_id", f"{text} AS text"))


def _budgeted(sp, d):
    return table(sp, d, "documents").select("doc_id", F.md5(tr.to_token_budget(F.col("text"), 120).cast("binary")).alias("out"))


def _cascade(sp, d):
    docs = table(sp, d, "documents")
    short = lambda n: tx.truncate_head(F.col("text"), n)
    forms = [("full", F.col("text")), ("structure", short(6)), ("types", short(3))]
    rows = docs.select("doc_id", F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), t.alias("text")) for m, t in forms))).alias("f")).select("doc_id", "f.*").withColumn("tokens", F.floor(F.octet_length("text") / 4))
    return tr.cascade(rows, 200).select("doc_id", "mode", F.md5(F.col("text").cast("binary")).alias("out"))


def _priority(sp, d):
    n = F.size(F.split("text", "\n"))
    span = lambda a, b, w: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), F.lit(w).alias("priority"))
    docs = table(sp, d, "documents").withColumn("spans", F.array(span(F.lit(0), F.lit(2), 5), span(n - 1, n, 3), span(n / 2, n / 2 + 3, 1)))
    return tr.truncate_by_priority(docs, 4).select("doc_id", F.md5(F.col("text").cast("binary")).alias("out"))


_COLOUR = "\x1b[1;31m"
_RULES = [("cargo test", "run test", ()), ("git status", "run git status", ("--json",)), ("ls", "list", ())]
_COMMANDS = ("cargo test -q && git status 2>/dev/null", "run x | run y", "make all; ls -l", "echo $(date)", "git status --json", "  ", "own go")


def _commands(sp, d):
    word = F.element_at(F.array(*map(F.lit, _COMMANDS)), (F.col("event_id") % len(_COMMANDS) + 1).cast("int"))
    return table(sp, d, "events").select(F.col("event_id").alias("cmd_id"), word.alias("command"))


def _tool_calls(sp, d):
    i = F.col("event_id")
    tool = F.when(i % 3 == 0, "Read").when(i % 3 == 1, "Bash").otherwise("Grep")
    command = F.when(i % 3 == 0, F.concat(F.lit("src/x"), F.element_at(F.array(F.lit(".rs"), F.lit(".bin"), F.lit(".py")), (i % 5 % 3 + 1).cast("int")))).when(i % 2 == 0, F.concat_ws(" ", F.lit("cargo test"), "event_type")).otherwise(F.concat_ws(" ", F.lit("make -j all"), "event_type"))
    return table(sp, d, "events").select(F.col("user_id").cast("string").alias("session_id"), i.alias("seq"), tool.alias("tool"), command.alias("command"), F.repeat("props", (i % 4).cast("int")).alias("result"))


def _transcripts(layout: str):
    """One session a remainder of 20, one call an event and, but for every third, its result, in the layout's own words."""

    def run(sp, d):
        e = table(sp, d, "events").selectExpr("event_id AS i", "event_type AS t", "concat('s', event_id % 20) AS session_id")
        if layout == "cursor":
            call = """concat('{"role":"assistant","tool_calls":[{"id":"', i, '","type":"function","function":{"name":"shell","arguments":"{\\\\"command\\\\":\\\\"run ', t, '\\\\"}"}}]}')"""
            done = """if(i % 3 > 0, concat(',{"role":"tool","tool_call_id":"', i, '","content":"out ', i, '"}'), '')"""
            rows = e.selectExpr("concat(session_id, '-', i) AS session_id", f"concat('{{\"composerData\":{{\"conversations\":[{{\"messages\":[', {call}, {done}, ']}}]}}}}') AS value")
            return src.parse_nested_sessions(rows)
        call = {
            "copilot": """concat('{"type":"tool_use","toolName":"shell","id":"', i, '","toolArgs":{"command":"run ', t, '"}}')""",
            "flat": """concat('{"type":"tool_use","tool":"shell","id":"', i, '","args":{"command":"run ', t, '"}}')""",
        }.get(layout, """concat('{"message":{"content":[{"type":"text"},{"type":"tool_use","id":"', i, '","name":"shell","input":{"command":"run ', t, '"}},{"type":"tool_use","id":"x', i, '","name":"more","input":{}}]}}')""")
        done = {
            "copilot": """concat('{"type":"tool_result","toolUseId":"', i, '","content":"out ', i, '","resultType":"', if(i % 3 = 1, 'error', 'success'), '"}')""",
            "flat": """concat('{"type":"tool_result","tool_use_id":"', i, '","content":"out ', i, '","is_error":', i % 3 = 1, '}')""",
        }.get(layout, """concat('{"message":{"content":[{"type":"tool_result","tool_use_id":"', i, '","content":"out ', i, '","is_error":', i % 3 = 1, '}]}}')""")
        rows = e.selectExpr("session_id", "i * 2 AS line_no", f"{call} AS line").unionByName(e.filter("i % 3 > 0").selectExpr("session_id", "i * 2 + 1 AS line_no", f"{done} AS line"))
        if layout == "calls":
            return src.parse_call_sessions(rows)
        return src.parse_flat_sessions(rows, "copilot") if layout == "copilot" else src.parse_sessions(rows).filter("tool <> 'more'")

    return run


def _stream(sp, d, step, mode: str, batch=None):
    """Run ``step`` over the events table (a file or a folder of files) as a stream, to its end; what it wrote, read back.

    The pattern keeps Spark from taking the path for a base folder, which a file can't be."""
    out = f"{scratch.shared_dir(sp).rstrip('/')}/stream-{uuid.uuid4().hex}"
    scratch.keep_until_end(sp, out)
    source = sp.readStream.schema(table(sp, d, "events").schema).option("recursiveFileLookup", "true").parquet(f"{d}/events.parque[t]")
    frame = step(source)
    query = frame.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{out}/state").foreachBatch(lambda df, n: df.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{out}/rows")).start()
    query.awaitTermination()
    return sp.read.schema(frame.schema).parquet(f"{out}/rows")


def _moves(sp, d):
    return _stream(sp, d, lambda e: jobs.job_transitions(e.select(F.col("user_id").cast("string").alias("job"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"))), "append")


def _live_savings(sp, d):
    def step(e):
        i = F.col("event_id")
        rows = e.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("command_type"), (F.floor(F.col("value") * 10) + i % 100).alias("raw_tokens"), (F.floor(F.col("value") * 4) + (i * 7) % 150).alias("compressed_tokens"))
        return jobs.windowed_savings(rows)

    return _stream(sp, d, step, "complete").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "command_type", "tokens_saved", "n")


def _refresh(sp, d):
    docs = table(sp, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), "doc_id")
    known = docs.filter("doc_id % 7 > 0").select("path", F.when(F.col("doc_id") % 5 == 0, F.lit("old")).otherwise(F.col("sha256")).alias("sha256"))
    return src.changed_files(docs, known).select("path")


def _resolved(sp, d):
    t = touches(sp, d)
    hub = t.agg(F.min("path")).first()[0]
    return h.resolve_partners(h.partners(h.cochange(t), hub, 0.0), h.dense_ids(t.filter("path NOT LIKE 'tests/%'")))


def _codec(sp, d):
    rows = files(sp, d).select("doc_id", serde.encode_field_map(F.col("field_map")).alias("triples"), "field_map")
    return rows.select("doc_id", "triples", F.coalesce(serde.decode_field_map(F.col("triples")).cast("string") == F.col("field_map").cast("string"), F.lit(False)).alias("same"))


def _spelt(sp, d, *tools: tuple[str, str]):
    """doc_id, tool, text: one (tool, SQL over ``i`` = event_id and ``t`` = event_type) after another."""
    pick = lambda k: "CASE i % " + str(len(tools)) + " " + " ".join(f"WHEN {n} THEN {x[k]}" for n, x in enumerate(tools)) + " END"
    rows = [(f"'{name}'", text) for name, text in tools]
    tools = tuple(rows)
    return table(sp, d, "events").selectExpr("event_id AS i", "event_type AS t").selectExpr("i AS doc_id", f"{pick(0)} AS tool", f"{pick(1)} AS text")


_MORE_TESTS = (
    ("cargo", r"""concat(repeat('{"type":"test","event":"ok","name":"a"}\n', cast(i % 7 as int)), repeat('{"type":"test","event":"failed","name":"b"}\n', cast(i % 3 as int)), '{"type":"test","event":"ignored","name":"c"}')"""),
    ("cypress", """concat('{"stats":{"passes":', i % 7, ',"failures":', i % 3, ',"pending":1,"duration":9}}')"""),
    ("swift", """concat('Executed ', i % 7 + i % 3, ' tests, with ', i % 3, ' failures (0 unexpected) in 0.5 (0.6) seconds')"""),
)
_MORE_ISSUES = (
    ("black", """concat('would reformat ', t, '.py')"""), ("prettier", """concat('[warn] src/', t, '.ts')"""), ("rustfmt", r"""concat('Diff in /x/', t, '.rs at line ', 1 + i % 50, ':\n-x')"""), ("dprint", """concat('from /x/', t, '.ts:')"""),
    ("golangci", """concat('{"Issues":[{"FromLinter":"errcheck","Text":"m","Severity":"","Pos":{"Filename":"', t, '.go","Line":', 1 + i % 50, '}}]}')"""),
    ("rubocop", """concat('{"files":[{"path":"', t, '.rb","offenses":[{"severity":"convention","message":"m","cop_name":"Style/X","location":{"line":', 1 + i % 50, '}}]}]}')"""),
    ("swiftlint", """concat('[{"file":"', t, '.swift","line":', 1 + i % 50, ',"reason":"m","rule_id":"long","severity":"Warning"}]')"""),
    ("oxlint", """concat('{"diagnostics":[{"filename":"', t, '.ts","message":"m","code":"no-x","severity":"error","labels":[{"span":{"line":', 1 + i % 50, '}}]}]}')"""),
)
_MAVEN = ("maven", r"""concat(repeat('[WARNING] w\n', cast(i % 4 as int)), repeat('[ERROR] /a/B.java:[3,4] bad\n', cast(i % 3 as int)), if(i % 3 = 0, '[INFO] BUILD SUCCESS', '[INFO] BUILD FAILURE'), '\n[INFO] Total time:  2.500 s')""")
_SCRIPT = ("npm", r"""concat('> ', t, '@1.0.0 build\n> x\n', if(i % 3 = 0, concat('npm ERR! Exit status ', 1 + i % 5), 'fine'))""")
_IMAGE = ("docker", r"""concat('#4 [1/', 2 + i % 5, '] FROM x\n', repeat('#4 CACHED\n', cast(i % 3 as int)), if(i % 4 = 0, '#5 ERROR: exit code: 1', concat('#7 writing image sha256:', lower(hex(i + 16)), ' done')))""")
_NAMES = ("nslookup", r"""concat('Server:\t\t10.0.0.', i % 9, '\nAddress:\t10.0.0.1#53\n\n', if(i % 3 = 0, concat('** server can', chr(39), 't find ', t, '.org: NXDOMAIN'), concat('Name:\t', t, '.org\nAddress: 1.2.3.', i % 200)))""")
_WGET = ("wget", r"""concat('--2024-01-02 03:04:05--  https://a.org/', t, '\nHTTP request sent, awaiting response... ', if(i % 3 = 0, '404 Not Found', concat('200 OK\nLength: ', i, ' (x) [text/html]\n', chr(39), t, chr(39), ' saved [', i, '/', i, ']')))""")
_POD = ("kubectl", r"""concat('Name:   ', t, '\nNamespace:  n', i % 5, '\nStatus:   Running\nEvents:\n', repeat('  Normal  Pulled  x\n', cast(i % 3 as int)), repeat('  Warning  BackOff  y\n', cast(i % 4 as int)))""")
_CHECKS = ("gh", r"""concat(repeat('build\tpass\t1m\tu\n', cast(i % 4 as int)), repeat(concat(t, '\tfail\t1m\tu\n'), cast(i % 3 as int)), 'late\tpending\t0\tu')""")


QUERIES = {
    "parse_more_tests": lambda sp, d: to.test_results(_spelt(sp, d, *_MORE_TESTS)).select("doc_id", "tool", "passed", "failed", "tier"),
    "parse_more_issues": lambda sp, d: to.tool_issues(_spelt(sp, d, *_MORE_ISSUES)),
    "parse_maven": lambda sp, d: to.build_results(_spelt(sp, d, _MAVEN)),
    "parse_scripts": lambda sp, d: to.script_results(_spelt(sp, d, _SCRIPT)),
    "parse_image_builds": lambda sp, d: to.image_builds(_spelt(sp, d, _IMAGE)),
    "parse_name_lookups": lambda sp, d: to.name_lookups(_spelt(sp, d, _NAMES)).withColumn("names", F.array_join("names", ",")).withColumn("addresses", F.array_join("addresses", ",")),
    "parse_downloads": lambda sp, d: to.downloads(_spelt(sp, d, _WGET)),
    "parse_descriptions": lambda sp, d: to.descriptions(_spelt(sp, d, _POD)),
    "parse_check_runs": lambda sp, d: to.check_runs(_spelt(sp, d, _CHECKS)).withColumn("failing", F.array_join("failing", ",")),
    "parse_diff_summary": lambda sp, d: to.diff_summary(p.diff_lines(_diffs(sp, d))),
    "parse_status": lambda sp, d: p.status_summary(_status(sp, d)),
    "parse_log_subjects": lambda sp, d: p.log_subjects(_status(sp, d)),
    "log_json": lambda sp, d: _json_lines(sp, d).select("doc_id", "pos", lg.json_level(F.col("line")).alias("level"), lg.json_message(F.col("line")).alias("message")),
    "log_frames": lambda sp, d: lg.last_frames(_lines(sp, d).select("doc_id", F.floor(F.col("pos") / 6).alias("entry"), "pos", F.col("raw").alias("frame"))).select("doc_id", "entry", F.md5(F.array_join("frames", "|").cast("binary")).alias("frames"), "elided"),
    "log_compress": _compressed(False),
    "log_compress_lossless": _compressed(True),
    "lint_places": lambda sp, d: lg.issue_places(table(sp, d, "events").select(F.col("event_id").alias("pos"), F.col("event_type").alias("rule"), F.col("user_id").cast("string").alias("file"), (F.col("event_id") % 100).alias("line"))),
    "text_line_range": lambda sp, d: table(sp, d, "documents").select("doc_id", tx.line_range(F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.when(x.rlike("[0-9]"), i + 1)), lambda x: x.isNotNull())).alias("r")).select("doc_id", "r.start", "r.end"),
    "text_gates": lambda sp, d: table(sp, d, "documents").select("doc_id", tx.keeps_savings(F.col("text"), tx.truncate_head(F.col("text"), 5)).alias("saves"), F.octet_length(tx.guardrail(F.col("text"), F.concat("text", F.lit(" and more")), F.octet_length("text"), F.octet_length("text") + F.col("doc_id") % 2)).alias("n")),
    "text_strip_ansi": lambda sp, d: table(sp, d, "documents").select("doc_id", F.md5(tx.strip_ansi(F.concat(F.lit(_COLOUR), F.replace("text", F.lit("\n"), F.lit("\x1b[0m\n")))).cast("binary")).alias("out")),
    "text_tidy": lambda sp, d: table(sp, d, "documents").select("doc_id", F.md5(tx.tidy(F.replace("text", F.lit("\n"), F.lit(" \t\n\n\n\n"))).cast("binary")).alias("out")),
    "text_safe_session": lambda sp, d: table(sp, d, "conversations").select("conv_id", "turn", tx.safe_session(F.concat_ws("-", "conv_id", "role")).alias("plain"), tx.safe_session(F.col("text")).alias("said")),
    "text_serde": lambda sp, d: touches(sp, d).select("path").distinct().select("path", F.coalesce(tx.is_serde(tx.language_of_path(F.concat("path", F.when(F.length("path") % 2 == 0, ".json").otherwise(".rs")))), F.lit(False)).alias("serde")),
    "text_elision": lambda sp, d: table(sp, d, "documents").select("doc_id", tx.elision_marker(F.size(F.split("text", "\n")), F.lit(5)).alias("marker")),
    "truncate_tokens": _budgeted,
    "truncate_cascade": _cascade,
    "truncate_priority": _priority,
    "json_equal_raw": lambda sp, d: table(sp, d, "events").select("event_id", jt.equal_raw_columns("props", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" \n"), "props")).when(F.col("event_id") % 3 == 1, F.replace("props", F.lit("}"), F.lit(".0}"))).otherwise(F.replace("props", F.lit("k"), F.lit("j")))).alias("same")),
    "parse_diff": lambda sp, d: p.diff_lines(_diffs(sp, d)),
    "classify_commands": lambda sp, d: p.classify_commands(_commands(sp, d), _RULES, ("run",), ("own",)),
    "session_reads": lambda sp, d: ss.discover_reads(_tool_calls(sp, d)),
    "session_unhandled": lambda sp, d: ss.unhandled_commands(_tool_calls(sp, d), _RULES),
    **{f"session_{k}": _transcripts(k) for k in ("copilot", "flat", "blocks", "calls", "cursor")},
    "stream_job_transitions": _moves,
    "stream_live_savings": _live_savings,
    "source_refresh": _refresh,
    "source_field_codec": _codec,
    "history_resolve_partners": _resolved,
    "search_distinct_ngrams": lambda sp, d: lx.distinct_ngrams(table(sp, d, "benchmark").select(F.col("text").alias("query")).distinct(), index(sp, d).weights()).select(F.md5(F.col("query").cast("binary")).alias("query"), "key", F.round("weight", 5).alias("weight")),
}

_RAW = "WITH raw AS (SELECT doc_id, unnest(range(0, len(l)))::INT AS pos, unnest(l) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
_LOGS = _RAW + r"""
, js AS (SELECT doc_id, 'full' AS tier, pos, CASE WHEN pos % 4 = 3 THEN 'DEBUG' ELSE 'INFO' END AS level, raw AS message, NULL AS ts FROM raw WHERE doc_id % 3 = 0
), fr AS (SELECT doc_id, pos // 6 AS entry, string_agg('at frame ' || pos || ' ' || md5(raw), chr(10) ORDER BY pos) AS frames, count(*) AS kept FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, pos // 6 ORDER BY pos DESC) AS back FROM raw WHERE doc_id % 3 = 1 AND pos % 6 > 0) WHERE back <= 3 GROUP BY 1, 2
), deep AS (SELECT DISTINCT doc_id FROM raw WHERE doc_id % 3 = 1 AND pos % 6 = 4
), en AS (SELECT r.doc_id, 'degraded' AS tier, pos, 'ERROR' AS level, 'entry ' || raw || coalesce(chr(10) || frames, '') AS message, '2024-01-02T03:04:' || lpad((pos % 60)::VARCHAR, 2, '0') || 'Z' AS ts FROM raw r LEFT JOIN fr ON fr.doc_id = r.doc_id AND fr.entry = pos // 6 WHERE r.doc_id % 3 = 1 AND pos % 6 = 0
), plain AS (SELECT doc_id, 'passthrough' AS tier, 0 AS pos, NULL AS level, md5('no ' || text) AS message, 1 AS count, NULL AS min_timestamp, NULL AS max_timestamp FROM documents WHERE doc_id % 3 = 2
), whole AS (SELECT doc_id, 'passthrough' AS tier, 0 AS pos, NULL AS level, md5(string_agg(CASE WHEN doc_id % 3 = 0 THEN to_json({'level': CASE WHEN pos % 4 = 3 THEN 'debug' ELSE 'info' END, 'msg': raw})::VARCHAR WHEN pos % 6 = 0 THEN '2024-01-02T03:04:' || lpad((pos % 60)::VARCHAR, 2, '0') || 'Z ERROR: entry ' || raw ELSE '    at frame ' || pos || ' ' || md5(raw) END, chr(10) ORDER BY pos)) AS message, 1 AS count, NULL AS min_timestamp, NULL AS max_timestamp FROM raw WHERE doc_id % 3 = 0 OR doc_id IN (SELECT doc_id FROM deep) GROUP BY doc_id)
"""
_MERGE = "doc_id, any_value(tier) AS tier, min(pos) AS pos, level, md5(min_by(message, pos)) AS message, count(*) AS count, min_by(ts, pos) AS min_timestamp, max_by(ts, pos) AS max_timestamp"
_NL = "chr(10)"
_DL = "(SELECT doc_id, text, string_split(regexp_replace(text, '\\r?\\n$', ''), chr(10)) AS l FROM documents)"
_CALLS = "calls AS (SELECT event_id AS i, user_id::VARCHAR AS session_id, CASE event_id % 3 WHEN 0 THEN 'Read' WHEN 1 THEN 'Bash' ELSE 'Grep' END AS tool, event_id % 3 = 0 AND event_id % 5 % 3 <> 1 AS code, length(props) * (event_id % 4) // 4 AS tokens, CASE WHEN event_id % 2 = 0 THEN 'cargo test ' || event_type ELSE 'make -j all ' || event_type END AS command FROM events)"


def _session(error: str, result: str = "CASE WHEN i % 3 > 0 THEN 'out ' || i END", session: str = "'s' || (i % 20)", seq: str = "row_number() OVER (PARTITION BY i % 20 ORDER BY i)::INT") -> str:
    return f"SELECT {session} AS session_id, {seq} AS seq, 'shell' AS tool, 'run ' || t AS command, {error} AS is_error, {result} AS result FROM (SELECT event_id AS i, event_type AS t FROM events)"


_ERR = "CASE WHEN i % 3 > 0 THEN i % 3 = 1 END"
_PAIRS = """
, small AS (SELECT DISTINCT hash, path FROM touches WHERE hash IN (SELECT hash FROM touches GROUP BY hash HAVING count(*) <= 50)
), nfile AS (SELECT path, count(*) AS n FROM small GROUP BY path
), hub AS (SELECT min(path) AS hub FROM touches
), found AS (SELECT b.path AS partner, count(*) AS count FROM hub JOIN small a ON a.path = hub JOIN small b ON a.hash = b.hash AND b.path <> hub GROUP BY 1
), ids AS (SELECT path, row_number() OVER (ORDER BY path) - 1 AS file_id FROM (SELECT DISTINCT path FROM touches WHERE path NOT LIKE 'tests/%'))
SELECT file_id, partner, count, round(count::DOUBLE / (x.n + y.n - count), 6) AS jaccard FROM found JOIN ids ON ids.path = partner JOIN nfile x ON x.path = partner JOIN nfile y ON y.path = (SELECT hub FROM hub)"""

_E = "FROM (SELECT event_id AS i, event_type AS t FROM events)"
_EXT = "(['.py', '.ts', '.rs', '.ts', '.go', '.rb', '.swift', '.ts'])[i % 8 + 1]"
ORACLES = {
    "parse_more_tests": f"SELECT i AS doc_id, (['cargo', 'cypress', 'swift'])[i % 3 + 1] AS tool, i % 7 AS passed, i % 3 AS failed, 'full' AS tier {_E}",
    "parse_more_issues": f"SELECT i AS doc_id, (['black', 'prettier', 'rustfmt', 'dprint', 'golangci', 'rubocop', 'swiftlint', 'oxlint'])[i % 8 + 1] AS tool, 0 AS pos, (['', 'src/', '/x/', '/x/', '', '', '', ''])[i % 8 + 1] || t || {_EXT} AS file, CASE WHEN i % 8 IN (2, 4, 5, 6, 7) THEN 1 + i % 50 END AS line, (['warning', 'warning', 'warning', 'warning', 'warning', 'info', 'warning', 'error'])[i % 8 + 1] AS severity, CASE WHEN i % 8 < 4 THEN 'not formatted' ELSE 'm' END AS message, (['black/format', 'prettier/format', 'rustfmt/format', 'dprint/format', 'errcheck', 'Style/X', 'long', 'no-x'])[i % 8 + 1] AS rule {_E}",
    "parse_maven": f"SELECT i AS doc_id, 'maven' AS tool, i % 3 = 0 AS success, i % 3 AS errors, i % 4 AS warnings, 2500 AS duration_ms {_E}",
    "parse_scripts": f"SELECT i AS doc_id, t || '@1.0.0' AS package, 'build' AS script, i % 3 > 0 AS success, CASE WHEN i % 3 = 0 THEN 1 + i % 5 END AS exit_code, (i % 3 = 0)::INT AS errors, 'full' AS tier {_E}",
    "parse_image_builds": f"SELECT i AS doc_id, 2 + i % 5 AS steps, i % 3 AS cached, CASE WHEN i % 4 > 0 THEN 'sha256:' || lower(to_hex(i + 16)) END AS image, i % 4 > 0 AS success, 'full' AS tier {_E}",
    "parse_name_lookups": f"SELECT i AS doc_id, '10.0.0.' || (i % 9) AS server, CASE WHEN i % 3 > 0 THEN t || '.org' ELSE '' END AS names, CASE WHEN i % 3 > 0 THEN '1.2.3.' || (i % 200) ELSE '' END AS addresses, CASE WHEN i % 3 = 0 THEN 'NXDOMAIN' END AS error, 'full' AS tier {_E}",
    "parse_downloads": f"SELECT i AS doc_id, 'https://a.org/' || t AS url, CASE WHEN i % 3 = 0 THEN 404 ELSE 200 END AS status, CASE WHEN i % 3 > 0 THEN i END AS bytes, CASE WHEN i % 3 > 0 THEN t END AS file, i % 3 > 0 AS success, 'full' AS tier {_E}",
    "parse_descriptions": f"SELECT i AS doc_id, t AS name, 'n' || (i % 5) AS namespace, 'Running' AS status, i % 3 AS normal, i % 4 AS warnings, 'full' AS tier {_E}",
    "parse_check_runs": f"SELECT i AS doc_id, i % 4 AS passed, i % 3 AS failed, 1 AS pending, 0 AS skipped, CASE WHEN i % 3 > 0 THEN t ELSE '' END AS failing, 'full' AS tier {_E}",
    "parse_diff_summary": f"SELECT i AS doc_id, t AS file, 1 AS hunks, i % 4 AS added, i % 3 AS removed, t || ' (+' || (i % 4) || ' -' || (i % 3) || ', 1 hunks)' AS text {_E}",
    "parse_status": f"SELECT i AS doc_id, t AS branch, i % 5 AS ahead, i % 3 AS behind, 1 AS staged, i % 4 AS unstaged, i % 3 AS untracked, 0 AS conflicts {_E}",
    "parse_log_subjects": f"SELECT i AS doc_id, (3 + i % 4 + i % 3)::INT AS pos, lpad(lower(to_hex(i)), 9, 'a') AS hash, t || ' subject' AS subject {_E}",
    "log_json": _RAW + " SELECT doc_id, pos, (['INFO', 'DEBUG', 'ERROR'])[pos % 3 + 1] AS level, CASE WHEN length(raw) > 16384 THEN substr(raw, 1, 16384) || '[truncated]' ELSE raw END AS message FROM raw",
    "log_frames": _RAW + " SELECT doc_id, pos // 6 AS entry, md5(string_agg(raw, '|' ORDER BY pos) FILTER (back <= 3)) AS frames, count(*) FILTER (back > 3)::INT AS elided FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, pos // 6 ORDER BY pos DESC) AS back FROM raw) GROUP BY 1, 2",
    "log_compress": _LOGS + f" SELECT {_MERGE} FROM (SELECT * FROM js WHERE level <> 'DEBUG' UNION ALL SELECT * FROM en) GROUP BY doc_id, level, lower(message) UNION ALL SELECT * FROM plain",
    "log_compress_lossless": _LOGS + f" SELECT {_MERGE} FROM en WHERE doc_id NOT IN (SELECT doc_id FROM deep) GROUP BY doc_id, level, en.message UNION ALL SELECT * FROM plain UNION ALL SELECT * FROM whole",
    "lint_places": "SELECT event_type AS rule, event_id AS pos, user_id || ':' || (event_id % 100) AS place FROM events",
    "text_line_range": _RAW + " SELECT doc_id, coalesce(min(pos + 1) FILTER (regexp_matches(raw, '[0-9]')), 0)::INT AS start, coalesce(max(pos + 2) FILTER (regexp_matches(raw, '[0-9]')), 0)::INT AS \"end\" FROM raw GROUP BY doc_id",
    "text_gates": f"SELECT doc_id, octet_length(encode({{t}})) < octet_length(encode(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))) AS saves, CASE WHEN octet_length(encode(text)) >= 256 AND doc_id % 2 = 1 THEN octet_length(encode(text)) ELSE octet_length(encode(text)) + 9 END::INT AS n FROM {_DL}".replace("{t}", r"regexp_replace(CASE WHEN len(l) <= 5 THEN text ELSE array_to_string(list_append(l[1:4], '... (' || (len(l) - 4) || ' lines truncated)'), chr(10)) END, '^\s+|\s+$', '', 'g')"),
    "text_strip_ansi": "SELECT doc_id, md5(text) AS out FROM documents",
    "text_tidy": rf"SELECT doc_id, md5(regexp_replace(regexp_replace(replace(text, {_NL}, ' ' || chr(9) || {_NL} || {_NL} || {_NL} || {_NL}), '(?m)[ \t\r]+$', '', 'g'), '\n{{4,}}', {_NL} || {_NL} || {_NL}, 'g')) AS out FROM documents",
    "text_safe_session": "SELECT conv_id, turn, true AS plain, regexp_matches(text, '^[A-Za-z0-9._-]{1,128}$') AS said FROM conversations",
    "text_serde": with_views(" SELECT DISTINCT path, length(path) % 2 = 0 AS serde FROM touches"),
    "text_elision": _RAW + " SELECT doc_id, CASE WHEN count(*) > 5 THEN '... ' || (count(*) - 5) || ' more (5 of ' || count(*) || ' shown)' END AS marker FROM raw GROUP BY doc_id",
    "truncate_tokens": rf"""WITH l AS (SELECT doc_id, unnest(range(0, len(l)))::INT AS pos, unnest(l) AS x FROM {_DL}), c AS (SELECT *, sum(ceil((octet_length(encode(x)) + 1) / 4.0)) OVER (PARTITION BY doc_id ORDER BY pos) AS s FROM l),
        t AS (SELECT doc_id, max(s) AS total, string_agg(x, chr(10) ORDER BY pos) FILTER (s <= 120 - 4) AS head FROM c GROUP BY 1)
        SELECT doc_id, md5(CASE WHEN total <= 120 THEN text ELSE coalesce(head || chr(10), '') || '... (truncated)' END) AS out FROM t JOIN documents USING (doc_id)""",
    "truncate_cascade": rf"""WITH f AS (SELECT doc_id, text AS a, CASE WHEN len(l) <= 6 THEN text ELSE array_to_string(list_append(l[1:5], '... (' || (len(l) - 5) || ' lines truncated)'), chr(10)) END AS b, CASE WHEN len(l) <= 3 THEN text ELSE array_to_string(list_append(l[1:2], '... (' || (len(l) - 2) || ' lines truncated)'), chr(10)) END AS c FROM {_DL})
        SELECT doc_id, CASE WHEN octet_length(encode(a)) // 4 <= 200 THEN 'full' WHEN octet_length(encode(b)) // 4 <= 200 THEN 'structure' ELSE 'types' END AS mode, md5(CASE WHEN octet_length(encode(a)) // 4 <= 200 THEN a WHEN octet_length(encode(b)) // 4 <= 200 THEN b ELSE c END) AS out FROM f""",
    "truncate_priority": "SELECT doc_id, md5(CASE WHEN len(l) <= 4 THEN text ELSE l[1] || chr(10) || l[2] || chr(10) || '... (' || (len(l) - 3) || ' lines omitted)' || chr(10) || l[len(l)] END) AS out FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)",
    "json_equal_raw": "SELECT event_id, event_id % 3 = 0 AS same FROM events",
    "parse_diff": """WITH e AS (SELECT event_id AS i, event_type AS t FROM events), b AS (
        SELECT i, t, 4 AS pos, ' ' AS mark, 5 + i AS n FROM e
        UNION ALL SELECT i, t, 5 + k, '-', 6 + i FROM (SELECT i, t, unnest(range(0, i % 3)) AS k FROM e)
        UNION ALL SELECT i, t, 5 + i % 3 + k, '+', 6 + i + k FROM (SELECT i, t, unnest(range(0, i % 4)) AS k FROM e)
        UNION ALL SELECT i, t, 5 + i % 3 + i % 4, ' ', 6 + i + i % 4 FROM e)
        SELECT i AS doc_id, pos::INT AS pos, t AS file, 1 AS hunk, mark, n::BIGINT AS new_line FROM b""",
    "classify_commands": "SELECT event_id AS cmd_id, (['rewritten', 'already_compact', 'rewritten', 'unhandled', 'unhandled', 'unhandled', 'unhandled'])[event_id % 7 + 1] AS kind, (['run test -q && run git status 2>/dev/null', NULL, 'make all; list -l', NULL, NULL, NULL, NULL])[event_id % 7 + 1] AS rewritten FROM events",
    "session_reads": f"WITH {_CALLS} SELECT count(*) AS calls, count(*) FILTER (tool = 'Read') AS reads, count(*) FILTER (code) AS code_reads, sum(tokens) FILTER (tool = 'Read')::BIGINT AS read_tokens, sum(floor(tokens * 0.7)) FILTER (code)::BIGINT AS potential FROM calls",
    "session_unhandled": f"WITH {_CALLS} SELECT 'make -j all' AS prefix, count(*) AS n FROM calls WHERE tool = 'Bash' AND starts_with(command, 'make')",
    "session_copilot": _session(_ERR),
    "session_flat": _session(_ERR),
    "session_blocks": _session(_ERR, seq="(2 * row_number() OVER (PARTITION BY i % 20 ORDER BY i) - 1)::INT"),
    "session_calls": _session("NULL::BOOLEAN", "NULL::VARCHAR"),
    "session_cursor": _session("NULL::BOOLEAN", session="'s' || (i % 20) || '-' || i", seq="1"),
    "stream_job_transitions": "SELECT job, seq, status FROM (SELECT user_id::VARCHAR AS job, event_id AS seq, event_type AS status, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before IS NULL OR before <> status",
    "stream_live_savings": with_views(" SELECT strftime(ts, '%Y-%m-%d') AS day, command_type, sum(greatest(raw_tokens - compressed_tokens, 0))::BIGINT AS tokens_saved, count(*) AS n FROM savings JOIN (SELECT event_id, ts FROM events) USING (event_id) GROUP BY 1, 2"),
    "source_refresh": "SELECT doc_id::VARCHAR AS path FROM documents WHERE doc_id % 7 = 0 OR doc_id % 5 = 0",
    "source_field_codec": "SELECT doc_id, '[' || array_to_string(list_filter([CASE WHEN n > 0 THEN '[0,' || least(n, 200) || ',0]' END, CASE WHEN n > 200 THEN '[200,' || least(n, 600) || ',4]' END, CASE WHEN n > 600 THEN '[600,' || n || ',7]' END], lambda x: x IS NOT NULL), ',') || ']' AS triples, true AS same FROM (SELECT doc_id, octet_length(encode(text)) AS n FROM documents)",
    "history_resolve_partners": with_views(_PAIRS),
    "search_distinct_ngrams": "WITH uniq AS (SELECT DISTINCT text FROM documents), grams AS (SELECT DISTINCT text, substr(hex(encode(text)), 2 * i + 1, 4) AS key FROM (SELECT text, unnest(range(0, octet_length(encode(text)) - 1)) AS i FROM uniq)), idf AS (SELECT key, (ln((SELECT count(*) FROM uniq)::DOUBLE / (count(*) + 1))::FLOAT + 1::FLOAT)::DOUBLE AS idf FROM grams GROUP BY key), q AS (SELECT DISTINCT text, substr(hex(encode(text)), 2 * i + 1, 4) AS key FROM (SELECT DISTINCT text, unnest(range(0, octet_length(encode(text)) - 1)) AS i FROM benchmark)) SELECT md5(text) AS query, key, round(coalesce(idf, 0), 5) AS weight FROM q LEFT JOIN idf USING (key)",
}
