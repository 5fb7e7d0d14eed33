"""Registered queries of session mining, structural search, JSON tools and windowed savings with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.functions import json_tools as jt
from brindle.operators import sessions as ss
from brindle.operators import structural as st
from brindle.plans.views import savings, table, with_views
from brindle.streaming import jobs


def _calls(sp, d):
    """Events as tool calls: one session a user, in the order of event ids; some commands are misspelt and fail."""
    e = table(sp, d, "events")
    word = F.element_at(F.array(F.lit("cargo tset"), F.lit("cargo test"), F.lit("ls"), F.lit("git status")), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(
        F.col("user_id").cast("string").alias("session_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("seq"), F.lit("Bash").alias("tool"),
        F.concat_ws(" ", word, F.col("event_type")).alias("command"), (F.col("event_id") % 4 == 0).alias("is_error"), F.col("props").alias("result"),
    )


def _test_runs(sp, d):
    """Events as test runs of two suites; every third fails."""
    i = F.col("event_id")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    command = F.when(i % 5 == 0, F.concat(F.lit("npm run test "), "event_type")).otherwise(F.concat(F.lit("cargo test unit "), "event_type"))
    return table(sp, d, "events").select(F.col("user_id").cast("string").alias("session_id"), seq.alias("seq"), F.lit("Bash").alias("tool"), command.alias("command"), (i % 3 == 0).alias("is_error"), F.col("props").alias("result"))


def _nodes(sp, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    li = table(sp, d, "lineitem").withColumn("ord", F.row_number().over(w) - 1)
    return li.select(F.col("l_orderkey").alias("doc_id"), "ord", F.concat("l_returnflag", "l_linestatus").alias("kind"), (F.col("ord") % 3).alias("depth"))


def _langs(sp, d):
    return table(sp, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("lang"))


def _structural(sp, d):
    nodes = _nodes(sp, d)
    grams = st.ngrams(nodes)
    return st.search(grams, nodes, st.idf(grams, _langs(sp, d)), _langs(sp, d), "AF > RO").limit(50)


def _windows(sp, d):
    e = table(sp, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return jobs.windowed_savings(savings(sp, d).join(e, "event_id")).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "command_type", "tokens_saved", "n")


QUERIES = {
    "json_minify": lambda sp, d: table(sp, d, "events").select("event_id", jt.minify_column("props").alias("out")),
    "json_structure": lambda sp, d: table(sp, d, "events").select(jt.structure_column("props").alias("shape")).groupBy("shape").agg(F.count("*").alias("n")),
    "json_equal": lambda sp, d: table(sp, d, "events").select("event_id", jt.equal_columns("props", F.concat(F.lit(" "), "props")).alias("same")),
    "session_discover": lambda sp, d: ss.discover(_calls(sp, d)),
    "session_corrections": lambda sp, d: ss.corrections(_calls(sp, d)),
    "session_rules": lambda sp, d: ss.correction_rules(ss.corrections(_calls(sp, d)), 2),
    "session_tdd_cycles": lambda sp, d: ss.tdd_cycles(_test_runs(sp, d)),
    "structural_ngrams": lambda sp, d: st.ngrams(_nodes(sp, d)),
    "structural_search": _structural,
    "stream_windowed_savings": _windows,
}

_CALLS = "calls AS (SELECT user_id::VARCHAR AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, (['cargo tset', 'cargo test', 'ls', 'git status'])[event_id % 4 + 1] || ' ' || event_type AS command, event_id % 4 = 0 AS failed, props FROM events)"
_GRAMS = """
n AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS ord, l_returnflag || l_linestatus AS kind FROM lineitem
), k AS (SELECT doc_id, ord, kind AS c, lag(kind) OVER w AS p, lag(kind, 2) OVER w AS gp FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY ord)
), g AS (SELECT doc_id, NULL AS gp, p, c FROM k WHERE ord % 3 > 0 UNION ALL SELECT doc_id, gp, p, c FROM k WHERE ord % 3 = 2
), t AS (SELECT doc_id, gp, p, c, count(*) AS count FROM g GROUP BY ALL)
"""
ORACLES = {
    "json_minify": r"SELECT event_id, regexp_replace(props, '\s', '', 'g') AS out FROM events",
    "json_structure": "SELECT '{' || chr(10) || '  k' || chr(10) || '}' AS shape, count(*) AS n FROM events WHERE json_valid(props) GROUP BY 1",
    "json_equal": "SELECT event_id, true AS same FROM events",
    "session_discover": "SELECT split_part(command, ' ', 1) AS command, count(*) AS calls, sum(length(props) // 4)::BIGINT AS tokens, sum(floor(length(props) // 4 * 0.7))::BIGINT AS potential FROM (SELECT (['cargo tset', 'cargo test', 'ls', 'git status'])[event_id % 4 + 1] AS command, props FROM events) GROUP BY 1",
    "session_corrections": "WITH " + _CALLS + """
, ahead AS (SELECT a.session_id, a.seq, list(b.failed ORDER BY b.seq) AS f FROM calls a JOIN calls b ON a.session_id = b.session_id AND b.seq BETWEEN a.seq + 1 AND a.seq + 10 AND a.command = b.command WHERE a.failed GROUP BY 1, 2
), tdd AS (SELECT session_id, seq FROM ahead WHERE len(list_filter(range(1, len(f) + 1), lambda i: f[i] <> CASE WHEN i = 1 THEN true ELSE f[i - 1] END)) >= 2
), p AS (SELECT a.session_id, a.seq, a.command, b.command AS fixed, b.seq AS seq_at FROM calls a JOIN calls b ON a.session_id = b.session_id AND b.seq BETWEEN a.seq + 1 AND a.seq + 5 AND NOT b.failed
  WHERE a.failed AND starts_with(b.command, 'cargo test ') AND levenshtein(a.command, b.command) BETWEEN 1 AND 3 AND NOT EXISTS (SELECT 1 FROM tdd WHERE tdd.session_id = a.session_id AND tdd.seq = a.seq))
SELECT session_id, seq, command, arg_min(fixed, seq_at) AS fixed, 'typo' AS kind FROM p GROUP BY ALL""",
    "session_tdd_cycles": """WITH r AS (SELECT user_id::VARCHAR AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, event_id % 5 = 0 AS suite, event_id % 3 = 0 AS failed FROM events
), ahead AS (SELECT a.session_id, a.seq, list(b.failed ORDER BY b.seq) FILTER (a.suite = b.suite) AS f FROM r a JOIN r b ON a.session_id = b.session_id AND b.seq BETWEEN a.seq + 1 AND a.seq + 10 WHERE a.failed GROUP BY 1, 2)
SELECT session_id, seq FROM ahead WHERE len(list_filter(range(1, len(f) + 1), lambda i: f[i] <> CASE WHEN i = 1 THEN true ELSE f[i - 1] END)) >= 2""",
    "structural_ngrams": "WITH " + _GRAMS + " SELECT * FROM t",
    "structural_search": "WITH " + _GRAMS + """
, l AS (SELECT o_orderkey AS doc_id, o_orderstatus AS lang FROM orders), size AS (SELECT doc_id, count(*) AS nodes FROM n GROUP BY 1
), w AS (SELECT lang, (ln((SELECT count(*) FROM l m WHERE m.lang = l.lang)::DOUBLE / (count(*) + 1))::FLOAT + 1::FLOAT)::DOUBLE AS idf FROM t JOIN l USING (doc_id) WHERE gp IS NULL AND p = 'AF' AND c = 'RO' GROUP BY lang
), x AS (SELECT doc_id, count / (0.25 + 0.75 * nodes / (SELECT avg(nodes) FROM size)) AS tf, coalesce(idf, 1) AS idf FROM t JOIN l USING (doc_id) JOIN size USING (doc_id) LEFT JOIN w USING (lang) WHERE gp IS NULL AND p = 'AF' AND c = 'RO')
SELECT doc_id, round(sum(idf * tf / (tf + 1.2)), 6) AS score FROM x GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 50""",
    "stream_windowed_savings": with_views(" SELECT strftime(ts, '%Y-%m-%d') AS day, command_type, sum(greatest(raw_tokens - compressed_tokens, 0))::BIGINT AS tokens_saved, count(*) AS n FROM savings JOIN (SELECT event_id, ts FROM events) USING (event_id) GROUP BY 1, 2"),
}
ORACLES["session_rules"] = f"""SELECT array_to_string(string_split(command, ' ')[1:3], ' ') AS wrong, array_to_string(string_split(fixed, ' ')[1:3], ' ') AS "right", count(*) AS occurrences, count(DISTINCT session_id) AS sessions
FROM ({ORACLES["session_corrections"]}) GROUP BY 1, 2 HAVING count(*) >= 2"""
