"""Registered queries of text functions and log reduction with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import logs as lg
from brindle.functions import text as tx
from brindle.plans.views import table

SAMPLES = [
    "src/main.rs", "a/../b.py", "lib/x.PY", "Makefile", "web/app.min.tsx", "#!/usr/bin/env -S python3.11", "#!/bin/sh", "#! /usr/local/bin/node", "MY_API_KEY=abc", "export DB_TOKEN=1",
    "PATH=/bin", "X=sk-ant-12345678", "url=https://u:p@host/x", "```py\nx\n```", "```", "2024-01-02 x", "[ERROR] boom", "WARN: disk\nINFO ok", "[abc] hi", "plain text",
    "cargo build --release now", "git  commit -m x", "error: no such file", "12 passed, 0 failed", "3 failed", "The call has been Denied", "x: error[1]", "[2024-06", "7d", "12h", "3x", "2w",
    "@@ -1,5 +2 @@ fn", "@@ -3 +4,9 @@", "d/{a => b}/f", "plain/path", "gpt-4", "gpt-4o-mini", "claude-x", "o3-mini", "llama", "a b/c d", "a x/y d",
]


def _texts(sp, d):
    """Every document (id >= 0), every event's properties (below 0) and a few spelt-out texts (from 10 ** 12) that rules are about."""
    docs = table(sp, d, "documents").select(F.col("doc_id").alias("id"), "text")
    events = table(sp, d, "events").select((-1 - F.col("event_id")).alias("id"), F.col("props").alias("text"))
    return docs.unionByName(events).unionByName(sp.createDataFrame([(10**12 + i, x) for i, x in enumerate(SAMPLES)], "id bigint, text string"))


def _on(f):
    return lambda sp, d: _texts(sp, d).select("id", f(F.col("text")).alias("out"))


def _log_lines(sp, d):
    """Documents' lines, all and whole, as log lines: levels and stamps by position."""
    rows = table(sp, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    level = F.element_at(F.array(F.lit("[INFO] "), F.lit("ERROR: "), F.lit(""), F.lit("[debug] ")), (F.col("pos") % 4 + 1).cast("int"))
    stamp = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("2024-01-02T03:04:"), F.lpad((F.col("pos") % 60).cast("string"), 2, "0"), F.lit("Z "))).otherwise("")
    return rows.select("doc_id", "pos", F.concat(stamp, level, "raw").alias("line"))


def _doc(f, name="out"):
    return lambda sp, d: table(sp, d, "documents").select("doc_id", f(F.col("text")).alias(name))


_PAIRS = [("git comit", "git commit"), ("ls a/b", "ls c/d"), ("ls a/b", "ls c/d e"), ("x" * 30, "y"), ("same", "same")]



def _pairs(sp, d):
    """Pairs of commands: one an event, of its type and value, and a few spelt-out ones."""
    e = table(sp, d, "events").selectExpr("concat('run ', event_type, ' src/', user_id, ' -n ', event_id % 7) AS a", "concat(if(event_id % 3 = 0, 'rn ', 'run '), event_type, if(event_id % 2 = 0, ' lib/', ' src/'), user_id, if(event_id % 5 = 0, repeat(' more', 3), concat(' -n ', event_id % 11))) AS b")
    return e.unionByName(sp.createDataFrame(_PAIRS, "a string, b string"))


QUERIES = {
    "text_language_path": _on(tx.language_of_path),
    "text_language_shebang": _on(tx.language_of_shebang),
    "text_sensitive": lambda sp, d: _texts(sp, d).select("id", tx.sensitive_key(F.col("text")).alias("k"), tx.sensitive_value(F.col("text")).alias("v")),
    "text_redact_env": _on(tx.redact_env),
    "text_fence": lambda sp, d: _texts(sp, d).select("id", tx.is_fenced(F.col("text")).alias("fenced"), tx.fence_hint(F.col("text")).alias("hint")),
    "text_log_rule": _on(tx.looks_like_log),
    "text_classify": lambda sp, d: tx.classify(table(sp, d, "documents"), "text").groupBy("content_class").agg(F.count("*").alias("n")),
    "text_classify_events": lambda sp, d: tx.classify(table(sp, d, "events"), "props").groupBy("content_class").agg(F.count("*").alias("n")),
    "text_route": lambda sp, d: tx.classify(table(sp, d, "events"), "props").select("event_id", tx.engine(F.col("content_class")).alias("engine"), tx.prefilter(F.col("props"), F.col("content_class")).alias("looked_at")),
    "text_minified": lambda sp, d: table(sp, d, "pages").select("page_id", tx.is_minified(F.col("html")).alias("minified")),
    "text_error_rule": lambda sp, d: _texts(sp, d).select("id", tx.looks_like_error(F.col("text")).alias("error"), tx.is_denial(F.col("text")).alias("denied")),
    "text_command_prefix": _on(tx.command_prefix),
    "text_duration": _on(tx.duration_seconds),
    "text_hunk_header": lambda sp, d: _texts(sp, d).select("id", *tx.hunk_header(F.col("text"))),
    "text_rename": _on(tx.rename_target),
    "text_encoding": _on(tx.encoding_for_model),
    "text_edit_distance": lambda sp, d: _pairs(sp, d).select("a", "b", tx.bounded_levenshtein(F.col("a"), F.col("b")).alias("distance"), tx.path_only_difference(F.col("a"), F.col("b")).alias("path_only")),
    "text_truncate_head": _doc(lambda c: F.md5(tx.truncate_head(c, 3).cast("binary"))),
    "text_truncate_tail": _doc(lambda c: F.md5(tx.truncate_tail(c, 3).cast("binary"))),
    "text_content_hash": _doc(lambda c: F.sha2(c.cast("binary"), 256), "sha256"),
    "text_byte_counts": lambda sp, d: table(sp, d, "documents").select("doc_id", F.octet_length("text").alias("bytes"), tx.offline_tokens(F.octet_length("text")).alias("offline"), tx.bounded_tokens(F.col("text")).alias("bounded")),
    "text_byte_gate": lambda sp, d: table(sp, d, "documents").select("doc_id", F.octet_length(tx.byte_gate(F.col("text"), F.concat(F.substring("text", 1, 900), F.lit("!" * 40)))).alias("bytes")),
    "log_entries": lambda sp, d: lg.entries(_log_lines(sp, d)),
    "log_deduplicate": lambda sp, d: lg.deduplicate(lg.entries(_log_lines(sp, d))),
    "log_deduplicate_lossless": lambda sp, d: lg.deduplicate(lg.entries(_log_lines(sp, d)), lossless=True, keep_debug=True),
    "log_totals": lambda sp, d: lg.totals(lg.entries(_log_lines(sp, d))),
    "lint_groups": lambda sp, d: lg.group_issues(table(sp, d, "events").select(F.col("event_id").alias("pos"), F.col("event_type").alias("rule"), F.when(F.col("event_id") % 3 == 0, "error").otherwise("warning").alias("severity"), F.col("user_id").cast("string").alias("file"), (F.col("event_id") % 100).alias("line"))),
}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_S = "WITH s AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT -1 - event_id, props FROM events UNION ALL SELECT unnest(range(1000000000000, %d)), unnest([%s]))" % (10**12 + len(SAMPLES), ", ".join(_q(x) for x in SAMPLES))
_P = "WITH p(a, b) AS (SELECT 'run ' || event_type || ' src/' || user_id || ' -n ' || (event_id % 7), CASE WHEN event_id % 3 = 0 THEN 'rn ' ELSE 'run ' END || event_type || CASE WHEN event_id % 2 = 0 THEN ' lib/' ELSE ' src/' END || user_id || CASE WHEN event_id % 5 = 0 THEN ' more more more' ELSE ' -n ' || (event_id % 11) END FROM events UNION ALL VALUES " + ", ".join(f"({_q(a)}, {_q(b)})" for a, b in _PAIRS) + ")"
_EXT = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in tx.EXTENSIONS.items()) + "}"
_INT = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in tx.INTERPRETERS.items()) + "}"
_KEY = f"(upper({{0}}) IN {tx.SENSITIVE_NAMES} OR regexp_matches(upper({{0}}), '({'|'.join(tx.SENSITIVE_SUFFIXES)})$'))"
_VAL = f"(octet_length(encode({{0}})) >= 8 AND regexp_matches({{0}}, '^({'|'.join(tx.CREDENTIAL_PREFIXES)})'))"
_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_LINE = rf"(regexp_matches(trim(x, chr(32) || chr(9) || chr(13)), '^(\d{{4}}-\d{{2}}|\d{{10}}|\[\d{{4}}-[^\]]{{2}})') OR regexp_matches(trim(x, chr(32) || chr(9) || chr(13)), '^(?:({tx.LEVELS})(?:$|[: \t])|\[({tx.LEVELS})\])') OR regexp_matches(trim(x, chr(32) || chr(9) || chr(13)), '^\[[^\]]{{0,31}}\][ :]'))"


def _log(col: str) -> str:
    lines = rf"list_filter(string_split({col}, chr(10)), lambda x: regexp_matches(x, '\S'))"
    return f"(len(list_filter({lines}, lambda x: {_LINE})) > 0 AND len(list_filter({lines}, lambda x: {_LINE})) * 2 >= len({lines}))"


_LINES = r"string_split(regexp_replace(text, '\r?\n$', ''), chr(10))"
_LOGS = rf"""WITH raw AS (SELECT doc_id, unnest(range(0, len(l)))::INT AS pos, unnest(l) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
), line AS (SELECT doc_id, pos, CASE WHEN pos % 3 = 0 THEN '2024-01-02T03:04:' || lpad((pos % 60)::VARCHAR, 2, '0') || 'Z ' ELSE '' END || (['[INFO] ', 'ERROR: ', '', '[debug] '])[pos % 4 + 1] || raw AS line FROM raw
), cut AS (SELECT doc_id, pos, trim(regexp_extract(line, '{lg.STAMP}')) AS ts, regexp_replace(line, '{lg.STAMP}', '') AS rest FROM line WHERE regexp_matches(line, '\S')
), lv AS (SELECT *, upper(regexp_extract(rest, '{lg.LEVEL}', 1) || regexp_extract(rest, '{lg.LEVEL}', 2)) AS lv FROM cut
), e AS (SELECT doc_id, pos, nullif(ts, '') AS ts, nullif(lv, '') AS level, CASE WHEN lv <> '' THEN regexp_extract(rest, '{lg.LEVEL}', 3) ELSE rest END AS message FROM lv)"""
_DEDUP = " SELECT doc_id, min(pos) AS pos, level, min_by(message, pos) AS message, count(*) AS count, min_by(ts, pos) FILTER (ts IS NOT NULL) AS min_timestamp, max_by(ts, pos) FILTER (ts IS NOT NULL) AS max_timestamp FROM e"

ORACLES = {
    "text_language_path": _S + rf" SELECT id, CASE WHEN NOT regexp_matches(text, '(^|/)\.\.(/|$)') THEN {_EXT}[regexp_extract(text, '[^/]\.([A-Za-z0-9]+)$', 1)] END AS out FROM s",
    "text_language_shebang": _S + rf" SELECT id, {_INT}[regexp_replace(regexp_extract(text, '^#!\s*(?:\S*/)?(?:env\s+(?:-\S+\s+)*)?(?:\S*/)?(\S+)', 1), '[0-9.]+$', '')] AS out FROM s",
    "text_sensitive": _S + f" SELECT id, {_KEY.format('text')} AS k, {_VAL.format('text')} AS v FROM s",
    "text_redact_env": _S + rf", k AS (SELECT id, text, regexp_extract(text, '^(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)=', 1) AS k, regexp_extract(text, '^[^=]*=(.*)$', 1) AS v FROM s) SELECT id, CASE WHEN k <> '' AND ({_KEY.format('k')} OR {_VAL.format('v')}) THEN regexp_extract(text, '^([^=]*=)', 1) || '***' ELSE regexp_replace(text, '(://)[^:@/\s]+:[^@/\s]+(@)', '\1***\2', 'g') END AS out FROM k",
    "text_fence": _S + f" SELECT id, starts_with({_TRIM.format('text')}, '```') AND ends_with({_TRIM.format('text')}, '```') AND length({_TRIM.format('text')}) >= 6 AND contains({_TRIM.format('text')}, chr(10)) AS fenced, regexp_extract(text, '```([A-Za-z0-9_+-]*)', 1) AS hint FROM s",
    "text_log_rule": _S + f" SELECT id, {_log('text')} AS out FROM s",
    "text_classify": f"SELECT CASE WHEN starts_with(t, '```') AND ends_with(t, '```') AND length(t) >= 6 AND contains(t, chr(10)) THEN 'code' WHEN regexp_matches(t, '^[{{\\[]') AND json_valid(t) THEN 'json' WHEN {_log('text')} THEN 'log' WHEN contains(text, '```') THEN 'mixed' ELSE 'text' END AS content_class, count(*) AS n FROM (SELECT text, {_TRIM.format('text')} AS t FROM documents) GROUP BY 1",
    "text_classify_events": "SELECT CASE WHEN json_valid(props) THEN 'json' ELSE 'text' END AS content_class, count(*) AS n FROM events GROUP BY 1",
    "text_route": "SELECT event_id, CASE WHEN json_valid(props) THEN 'json' ELSE 'passthrough' END AS engine, json_valid(props) AND length(props) BETWEEN 64 AND 65536 AS looked_at FROM events",
    "text_minified": "SELECT page_id, CASE WHEN n0 = 0 THEN b > 500 ELSE b // n0 > 500 END AS minified FROM (SELECT page_id, least(octet_length(encode(html)), 8192) AS b, len(list_filter(range(0, least(octet_length(encode(html)), 8192)), lambda i: substr(hex(encode(html)), 2 * i + 1, 2) = '0A')) AS n0 FROM pages)",
    "text_error_rule": _S + r" SELECT id, regexp_matches(lower(text), '(^|\n|: )error[:\[]|not found|no such file|permission denied|^fatal:') OR (contains(lower(text), 'failed') AND NOT contains(lower(text), '0 failed')) OR contains(text, 'Exit code') AS error, regexp_matches(lower(text), 'has been denied|user denied|aborted by user|user rejected|permission was denied by user') AS denied FROM s",
    "text_command_prefix": _S + rf" SELECT id, array_to_string(regexp_split_to_array({_TRIM.format('text')}, '\s+')[1:3], ' ') AS out FROM s",
    "text_duration": _S + r" SELECT id, CASE WHEN regexp_matches(text, '^\d{1,9}[hdw]$') THEN regexp_extract(text, '^(\d+)', 1)::BIGINT * CASE right(text, 1) WHEN 'h' THEN 3600 WHEN 'd' THEN 86400 ELSE 604800 END END AS out FROM s",
    "text_hunk_header": _S + r", h AS (SELECT id, text, regexp_extract(text, '^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@', ['a', 'b', 'c', 'd']) AS m FROM s) SELECT id, try_cast(m.a AS BIGINT) AS old_start, CASE WHEN m.a <> '' THEN coalesce(try_cast(m.b AS BIGINT), 1) END AS old_count, try_cast(m.c AS BIGINT) AS new_start, CASE WHEN m.a <> '' THEN coalesce(try_cast(m.d AS BIGINT), 1) END AS new_count FROM h",
    "text_rename": _S + r" SELECT id, regexp_replace(text, '^([^{]*)\{.* => (.*)\}(.*)$', '\1\2\3') AS out FROM s",
    "text_encoding": _S + " SELECT id, CASE WHEN text IN ('gpt-4', 'gpt-3.5-turbo') THEN 'cl100k' WHEN regexp_matches(text, '^(gpt-|o1|o3|o4|chatgpt-)') THEN 'o200k' WHEN starts_with(text, 'claude-') THEN 'offline' ELSE 'heuristic' END AS out FROM s",
    "text_edit_distance": _P + " SELECT a, b, CASE WHEN abs(length(a) - length(b)) > 10 THEN abs(length(a) - length(b)) ELSE levenshtein(a, b) END AS distance, len(string_split(a, ' ')) = len(string_split(b, ' ')) AND a <> b AND len(list_filter(range(1, len(string_split(a, ' ')) + 1), lambda i: string_split(a, ' ')[i] <> string_split(b, ' ')[i] AND NOT (contains(string_split(a, ' ')[i], '/') AND contains(string_split(b, ' ')[i], '/')))) = 0 AS path_only FROM p",
    "text_truncate_head": f"SELECT doc_id, md5(CASE WHEN len(l) <= 3 THEN text ELSE array_to_string(list_append(l[1:2], '... (' || (len(l) - 2) || ' lines truncated)'), chr(10)) END) AS out FROM (SELECT doc_id, text, {_LINES} AS l FROM documents)",
    "text_truncate_tail": f"SELECT doc_id, md5(CASE WHEN len(l) <= 3 THEN text ELSE array_to_string(list_prepend('... (' || (len(l) - 2) || ' lines truncated)', l[-2:]), chr(10)) END) AS out FROM (SELECT doc_id, text, {_LINES} AS l FROM documents)",
    "text_content_hash": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "text_byte_counts": r"SELECT doc_id, octet_length(encode(text)) AS bytes, ceil(octet_length(encode(text)) * 1.25)::BIGINT AS offline, CASE WHEN octet_length(encode(text)) > 262144 OR len(list_filter(regexp_split_to_array(text, '\s'), lambda w: length(w) > 4096)) > 0 THEN octet_length(encode(text)) // 4 END AS bounded FROM documents",
    "text_byte_gate": "SELECT doc_id, least(octet_length(encode(text)), octet_length(encode(substr(text, 1, 900))) + 40) AS bytes FROM documents",
    "log_entries": _LOGS + " SELECT * FROM e",
    "log_deduplicate": _LOGS + _DEDUP + " WHERE coalesce(level, '') <> 'DEBUG' GROUP BY doc_id, level, lower(e.message)",
    "log_deduplicate_lossless": _LOGS + _DEDUP + " GROUP BY doc_id, level, e.message",
    "log_totals": _LOGS + ", t AS (SELECT doc_id, count(*) AS total, count(*) FILTER (level = 'DEBUG') AS hidden, count(DISTINCT coalesce(level, '') || '|' || lower(message)) FILTER (coalesce(level, '') <> 'DEBUG') AS unique_entries FROM e GROUP BY doc_id) SELECT *, greatest(total - unique_entries - hidden, 0) AS duplicates FROM t",
    "lint_groups": "SELECT event_type AS rule, count(*) AS count, min_by(CASE WHEN event_id % 3 = 0 THEN 'error' ELSE 'warning' END, event_id) AS severity, count(DISTINCT user_id) AS files, min_by(user_id || ':' || (event_id % 100), event_id) AS first FROM events GROUP BY 1",
}
