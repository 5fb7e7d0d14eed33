"""Registered queries of parsers and readers with their DuckDB equivalents; inputs are spelt from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import parsers as p
from brindle.plans.views import commits, table, touches, with_views
from brindle.sources import history_text as src


def _runs(sp, d):
    e = table(sp, d, "events")
    i = F.col("event_id")
    text = F.when(i % 5 == 4, F.lit("nothing to see")).otherwise(F.concat((i % 7).cast("string"), F.lit(" passed, "), (i % 3).cast("string"), F.lit(" failed"), F.when(i % 2 == 0, F.concat(F.lit(" in "), (i % 90).cast("string"), F.lit("s"))).otherwise("")))
    return e.select(i.alias("doc_id"), text.alias("text"))


def _lint(sp, d):
    e, i = table(sp, d, "events"), F.col("event_id")
    line = F.when(i % 4 == 3, F.lit("noise")).otherwise(F.format_string("src/%s.py:%d:7: %s: bad %s [%s]", F.col("event_type"), i % 400, F.when(i % 3 == 0, "error").otherwise("warning"), F.col("event_type"), F.concat(F.lit("R"), (i % 9).cast("string"))))
    return e.select((i % 50).alias("doc_id"), i.alias("pos"), line.alias("line"))


def _log(sp, d):
    head = commits(sp, d).select("hash", F.lit(0).cast("bigint").alias("line_no"), F.concat(F.lit("COMMIT:"), F.col("hash").cast("string"), F.lit("|"), F.col("author").cast("string"), F.lit("|"), F.col("ts").cast("string"), F.lit("|"), F.col("message")).alias("line"))
    body = touches(sp, d).groupBy("hash", "path").agg(F.sum("additions").alias("n")).select("hash", F.xxhash64("path").bitwiseAND((1 << 40) - 1).alias("line_no"), F.concat_ws("\t", F.col("n").cast("string"), F.lit("x"), F.concat(F.lit("{old => "), F.col("path"), F.lit("}.rs"))).alias("line"))
    return head.unionByName(body.withColumn("line_no", F.col("line_no") + 1)).select(F.col("hash").alias("source"), "line_no", "line")


_RULES = [("cargo test", "run test", ()), ("cargo", "run", ("--json",)), ("ls", "list", ())]


def _commands(sp, d):
    word = F.element_at(F.array(F.lit("CI=1 cargo test -q"), F.lit("cargo build --json"), F.lit("ls"), F.lit("make")), (F.col("event_id") % 4 + 1).cast("int"))
    return table(sp, d, "events").select(F.col("event_id").alias("cmd_id"), F.concat_ws(" ", word, "event_type").alias("command"))


QUERIES = {
    "parse_test_summary": lambda sp, d: p.test_summary(_runs(sp, d)),
    "parse_lint_issues": lambda sp, d: p.lint_issues(_lint(sp, d)),
    "parse_build_summary": lambda sp, d: p.build_summary(_lint(sp, d)),
    "parse_history_log": lambda sp, d: src.parse_history_log(_log(sp, d))[1].select("hash", "ts", "author", "path", "additions", "deletions"),
    "parse_deny_list": lambda sp, d: touches(sp, d).select("path").distinct().select("path", p.is_denied(F.concat("path", F.lit("/dist/x.js"))).alias("dist"), p.is_denied(F.concat("path", F.lit("/x.min.js"))).alias("min"), p.is_denied(F.col("path")).alias("plain")),
    "match_rewrites": lambda sp, d: p.match_rewrites(_commands(sp, d), _RULES),
}

_LINT = "lint AS (SELECT event_id % 50 AS doc_id, event_id AS pos, event_type, event_id % 400 AS n, CASE WHEN event_id % 3 = 0 THEN 'error' ELSE 'warning' END AS severity, 'R' || (event_id % 9) AS rule, event_id % 4 = 3 AS noise FROM events)"
ORACLES = {
    "parse_test_summary": "SELECT event_id AS doc_id, CASE WHEN none THEN 0 ELSE event_id % 7 END AS passed, CASE WHEN none THEN 0 ELSE event_id % 3 END AS failed, 0 AS skipped, CASE WHEN NOT none AND event_id % 2 = 0 THEN (event_id % 90)::DOUBLE END AS duration_s, CASE WHEN none OR event_id % 21 = 0 THEN 'passthrough' WHEN event_id % 2 = 0 THEN 'full' ELSE 'degraded' END AS tier FROM (SELECT event_id, event_id % 5 = 4 AS none FROM events)",
    "parse_lint_issues": f"WITH {_LINT} SELECT doc_id, pos, 'src/' || event_type || '.py' AS file, n AS line, severity, 'bad ' || event_type AS message, rule FROM lint WHERE NOT noise",
    "parse_build_summary": f"WITH {_LINT} SELECT doc_id, count(*) FILTER (NOT noise AND severity = 'error') AS errors, count(*) FILTER (NOT noise AND severity = 'warning') AS warnings, count(*) FILTER (NOT noise AND severity = 'error') = 0 AS success, min_by('src/' || event_type || '.py:' || n || ':7: error: bad ' || event_type || ' [' || rule || ']', pos) FILTER (NOT noise AND severity = 'error') AS first_error FROM lint GROUP BY doc_id",
    "parse_history_log": with_views(" SELECT hash::VARCHAR AS hash, any_value(ts) AS ts, any_value(author)::VARCHAR AS author, path || '.rs' AS path, sum(additions)::BIGINT AS additions, 0 AS deletions FROM touches GROUP BY hash, path"),
    "parse_deny_list": with_views(" SELECT DISTINCT path, true AS dist, true AS min, starts_with(path, 'vendor/') AS plain FROM touches"),
    "match_rewrites": "SELECT event_id AS cmd_id, CASE event_id % 4 WHEN 0 THEN 'CI=1 run test -q ' || event_type WHEN 2 THEN 'list ' || event_type END AS rewritten FROM events",
}
