"""Registered queries of the savings and history families with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import history as h
from brindle.operators import savings as s
from brindle.plans.views import NOW, commits, savings, touches, with_kept_views, with_views
from brindle.sources.scratch import written

_SAVED = "greatest(raw_tokens - compressed_tokens, 0)"
_PCT = "(CASE WHEN raw_tokens = 0 OR compressed_tokens >= raw_tokens THEN 0 ELSE (raw_tokens - compressed_tokens)::FLOAT / raw_tokens::FLOAT * 100::FLOAT END)::DOUBLE"
_MEASURES = f"count(*) AS invocations, sum({_SAVED})::BIGINT AS tokens_saved, round(avg({_PCT}), 4) AS avg_savings_pct"
_SINCE = 1_704_800_000
_DECAY = f"exp(-(greatest({NOW} - greatest(ts, 0), 0) / 86400.0) / 30.0)"



def _kept(sp, d):
    """(touches, commits) without excluded paths; stored, since several metrics read them."""
    t, c = h.without_excluded(touches(sp, d), commits(sp, d))
    t = written(t, "touches")
    return t, c.join(t.select("hash"), "hash", "left_semi")


def _heatmap(sp, d):
    t, c = _kept(sp, d)
    return h.heatmap(t, c, NOW)


def _insights(sp, d):
    t, c = _kept(sp, d)
    radius = written(h.blast_radius(t), "radius")
    return h.insights(h.heatmap(t, c, NOW, radius), h.encapsulation(t), radius)


def _without_excluded(sp, d):
    t, c = h.without_excluded(touches(sp, d), commits(sp, d))
    return h.churn(t, c)


QUERIES = {
    "savings_summary": lambda sp, d: s.summary(savings(sp, d), _SINCE),
    "savings_daily": lambda sp, d: s.daily(savings(sp, d)),
    "savings_by_command": lambda sp, d: s.by_command(savings(sp, d)),
    "savings_by_language": lambda sp, d: s.by_language(savings(sp, d)),
    "savings_by_mode": lambda sp, d: s.by_mode(savings(sp, d)),
    "savings_tier_distribution": lambda sp, d: s.tier_distribution(savings(sp, d)),
    "savings_top_commands": lambda sp, d: s.top_commands(savings(sp, d)),
    "savings_sessions": lambda sp, d: s.sessions(savings(sp, d)),
    "savings_weighted": lambda sp, d: s.weighted_pct(savings(sp, d)),
    "savings_cost": lambda sp, d: s.cost_estimate(savings(sp, d)),
    "savings_prune": lambda sp, d: s.prune(savings(sp, d), 1_714_000_000).select("event_id", "timestamp"),
    "savings_clean": lambda sp, d: s.clean(savings(sp, d)).select("event_id", "raw_tokens", "compressed_tokens"),
    "savings_rollup": lambda sp, d: s.by_day_and_command(savings(sp, d)),
    "history_churn": lambda sp, d: h.churn(touches(sp, d), commits(sp, d)),
    "history_file_risk": lambda sp, d: h.file_risk(touches(sp, d), NOW),
    "history_temporal_stats": lambda sp, d: h.temporal_stats(touches(sp, d), NOW),
    "history_cochange": lambda sp, d: h.cochange(touches(sp, d)),
    "history_partners": lambda sp, d: h.partners(h.cochange(touches(sp, d)), _hub(sp, d), 0.0),
    "history_coupling": lambda sp, d: h.coupling(h.blast_radius(touches(sp, d))),
    "history_coupling_wide": lambda sp, d: h.coupling(h.blast_radius(touches(sp, d), 0.02, 1)),
    "history_blast_radius": lambda sp, d: h.blast_radius(touches(sp, d)),
    "history_without_excluded": _without_excluded,
    "history_stability": lambda sp, d: h.stability(touches(sp, d), NOW),
    "history_authors": lambda sp, d: h.authors(touches(sp, d)),
    "history_fix_after_touch": lambda sp, d: h.fix_after_touch(touches(sp, d), commits(sp, d)),
    "history_fix_after_touch_wide": lambda sp, d: h.fix_after_touch(touches(sp, d), commits(sp, d), 500),
    "history_encapsulation": lambda sp, d: h.encapsulation(touches(sp, d)),
    "history_heatmap": _heatmap,
    "history_insights": _insights,
    "history_top_hotspots": lambda sp, d: h.top(h.file_risk(touches(sp, d), NOW), "score"),
    "history_top_coldspots": lambda sp, d: h.top(h.file_risk(touches(sp, d), NOW), "score", ascending=True),
    "history_top_risks": lambda sp, d: h.top(h.file_risk(touches(sp, d), NOW), "risk_score"),
    "history_scope": lambda sp, d: h.scope(h.churn(touches(sp, d), commits(sp, d)), _targets(sp)),
    "history_missing": lambda sp, d: h.missing(_targets(sp), touches(sp, d)),
    "history_resort_partners": lambda sp, d: h.resort_partners(h.partners(h.cochange(touches(sp, d)), _hub(sp, d), 0.0), h.file_risk(touches(sp, d), NOW)),
    "history_annotate": lambda sp, d: h.annotate(_targets(sp), h.file_risk(touches(sp, d), NOW)),
    "history_annotate_risky": lambda sp, d: h.annotate(_targets(sp), h.file_risk(touches(sp, d), NOW), "risky"),
    "history_window_start": lambda sp, d: h.window_start(commits(sp, d), NOW),
    "history_window_last": lambda sp, d: h.window_start(commits(sp, d), NOW, last=500, preset="month"),
    "history_window_preset": lambda sp, d: h.window_start(commits(sp, d), NOW, preset="half"),
    "history_split": lambda sp, d: h.split(commits(sp, d)),
    "history_quality_gate": lambda sp, d: h.quality_gate(touches(sp, d), commits(sp, d)),
    "history_dense_ids": lambda sp, d: h.dense_ids(touches(sp, d)),
    "history_fix_commits": lambda sp, d: commits(sp, d).select("hash", h.is_fix(F.concat(F.lit("a "), F.when(F.col("hash") % 3 == 0, "Bug").when(F.col("hash") % 3 == 1, "debug").otherwise("x-FIX"), F.lit(": y"))).alias("is_fix")),
}


def _hub(spark, sf_dir):
    """The first path: a file that is there at every scale."""
    return touches(spark, sf_dir).agg(F.min("path")).first()[0]


_NAMES = [f"Brand#{b}/{k}" for b in (11, 12, 23, 34, 55) for k in range(1, 40)]


def _targets(spark):
    return spark.createDataFrame([(p,) for p in _NAMES], "path string")


_TARGETS = ", targets AS (SELECT unnest([" + ", ".join(f"'{p}'" for p in _NAMES) + "]) AS path)"
_RISK = f"""
, raw AS (SELECT path, sum({_DECAY}) AS raw, coalesce(sum({_DECAY}) FILTER (is_fix), 0) AS fixed, count(*) AS total, count(*) FILTER (is_fix) AS fixes FROM touches GROUP BY path
), parts AS (SELECT *, CASE WHEN max(raw) OVER () > 0 THEN raw / max(raw) OVER () ELSE 0 END AS hot, CASE WHEN raw > 2.220446049250313e-16 THEN fixed / raw ELSE 0 END AS density FROM raw
), risk AS (SELECT path, round(hot, 6) AS score, total, fixes, round(density, 6) AS fix_density, round(hot * density, 6) AS risk_score FROM parts)
"""
_PAIRS = """
, small AS (SELECT DISTINCT hash, path FROM touches WHERE hash IN (SELECT hash FROM touches GROUP BY hash HAVING count(*) <= 50)
), nfile AS (SELECT path, count(*) AS n FROM small GROUP BY path
), pairs AS (SELECT a.path AS file_a, b.path AS file_b, count(*) AS count FROM small a JOIN small b ON a.hash = b.hash AND a.path < b.path GROUP BY 1, 2
), co AS (SELECT file_a, file_b, count, round(count::DOUBLE / (x.n + y.n - count), 6) AS jaccard FROM pairs JOIN nfile x ON x.path = file_a JOIN nfile y ON y.path = file_b
), partners AS (SELECT CASE WHEN file_a = (SELECT min(path) FROM touches) THEN file_b ELSE file_a END AS partner, count, jaccard FROM co WHERE file_a = (SELECT min(path) FROM touches) OR file_b = (SELECT min(path) FROM touches))
"""
def _coupling(threshold: float, support: int) -> str:
    """radius: directed, after the definition (every commit adds 1/sqrt(files) to its files); edges: undirected."""
    return f"""
, sized AS (SELECT hash, path, count(*) OVER (PARTITION BY hash) AS n FROM touches
), own AS (SELECT path, sum(1 / sqrt(n)) AS w_a FROM sized GROUP BY path
), multi AS (SELECT hash, path, 1 / sqrt(n) AS w FROM sized WHERE n BETWEEN 2 AND 50
), both_ways AS (SELECT a.path, b.path AS other, sum(a.w) AS w_ab, count(*) AS support FROM multi a JOIN multi b ON a.hash = b.hash AND a.path <> b.path GROUP BY 1, 2
), radius AS (SELECT b.path, other, round(w_ab / w_a, 6) AS confidence, support FROM both_ways b JOIN own USING (path) WHERE w_ab / w_a >= {threshold} AND support >= {support}
), edges AS (SELECT least(path, other) AS file_a, greatest(path, other) AS file_b, max(confidence) AS confidence, max(support) AS support FROM radius GROUP BY 1, 2)
"""


_STABILITY = f"""
, per AS (SELECT path, count(*) AS k, max(ts) AS ts, count(*) FILTER (is_fix) AS fixes FROM touches GROUP BY path
), stab AS (SELECT path, greatest(0, least(100, round(100 - (40.0 * k / max(k) OVER () + 35 * {_DECAY} + 25.0 * fixes / k))))::INT AS stability FROM per)
"""
_AUTHORS = """
, each AS (SELECT path, author, count(*) AS k, sum(count(*)) OVER (PARTITION BY path) AS total FROM touches GROUP BY path, author
), auth AS (SELECT path, round(max(k) * 100.0 / max(total), 6) AS top_author_pct, max(k) * 100.0 / max(total) > 80 AS single_owner, count(*) FILTER (k >= ceil(total * 0.05)) AS authors FROM each GROUP BY path)
"""


def _fixes(window: int) -> str:
    return f"""
, idx AS (SELECT hash, row_number() OVER (ORDER BY ts DESC, hash) - 1 AS i FROM commits
), seen AS (SELECT path, is_fix, i, max(is_fix::INT) OVER (PARTITION BY path ORDER BY i RANGE BETWEEN 1 FOLLOWING AND {window} FOLLOWING) AS ahead FROM touches JOIN idx USING (hash)
), shares AS (SELECT path, count(*) AS touches, count(*) FILTER (is_fix) * 100.0 / count(*) AS k, count(*) FILTER (NOT is_fix AND ahead = 1) * 100.0 / count(*) AS p, count(*) < 2 AS insufficient FROM seen GROUP BY path
), fixes AS (SELECT path, touches, CASE WHEN insufficient THEN 0 ELSE round(k, 6) END AS keyword_pct, CASE WHEN insufficient THEN 0 ELSE round(p, 6) END AS proximity_pct, CASE WHEN insufficient THEN 0 ELSE round(k + p, 6) END AS combined_pct, insufficient FROM shares)
"""


_MODULES = """
, placed AS (SELECT hash, path, split_part(path, '/', 1) AS module FROM touches WHERE contains(path, '/')
), mods AS (SELECT DISTINCT hash, module FROM placed
), wide AS (SELECT hash, count(*) > 1 AS crosses FROM mods GROUP BY hash
), enc AS (SELECT module, count(*) AS commits, count(*) FILTER (crosses) AS cross_commits, any_value(files) AS files, round((count(*) - count(*) FILTER (crosses)) * 100.0 / count(*), 6) AS encapsulation_pct
           FROM mods JOIN wide USING (hash) JOIN (SELECT module, count(DISTINCT path) AS files FROM placed GROUP BY 1) USING (module) GROUP BY module HAVING count(*) >= 3)
"""
_HEATMAP = f"""
, churn AS (SELECT path, count(*) AS touches, round(count(*)::DOUBLE / (SELECT count(*) FROM commits), 9) AS churn_rate FROM touches GROUP BY path
), degree AS (SELECT path, count(*) AS coupled FROM radius GROUP BY path
), heat AS (SELECT c.path, c.touches, churn_rate, stability, top_author_pct, single_owner, authors, keyword_pct, proximity_pct, combined_pct, insufficient, coalesce(coupled, 0) AS coupled
            FROM churn c JOIN stab USING (path) JOIN auth USING (path) JOIN fixes USING (path) LEFT JOIN degree USING (path))
"""

ORACLES = {
    "savings_summary": f" SELECT count(*) AS invocations, coalesce(sum(raw_tokens), 0)::BIGINT AS raw_tokens, coalesce(sum(compressed_tokens), 0)::BIGINT AS compressed_tokens, coalesce(sum({_SAVED}), 0)::BIGINT AS tokens_saved, round(coalesce(avg({_PCT}), 0), 4) AS avg_savings_pct FROM savings WHERE timestamp >= {_SINCE}",
    "savings_daily": f" SELECT strftime(to_timestamp(timestamp) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, {_MEASURES} FROM savings GROUP BY 1 ORDER BY 1 DESC",
    "savings_by_command": f" SELECT command_type, {_MEASURES}, round(avg(duration_ms), 4) AS avg_duration_ms FROM savings GROUP BY 1",
    "savings_by_language": f" SELECT language, {_MEASURES} FROM savings WHERE language IS NOT NULL GROUP BY 1",
    "savings_by_mode": f" SELECT mode, {_MEASURES} FROM savings WHERE mode IS NOT NULL GROUP BY 1",
    "savings_tier_distribution": " SELECT round(count(*) FILTER (parse_tier = 'full') * 100.0 / greatest(count(parse_tier), 1), 6) AS full_pct, round(count(*) FILTER (parse_tier = 'degraded') * 100.0 / greatest(count(parse_tier), 1), 6) AS degraded_pct, round(count(*) FILTER (parse_tier = 'passthrough') * 100.0 / greatest(count(parse_tier), 1), 6) AS passthrough_pct FROM savings",
    "savings_top_commands": f" SELECT original_cmd, {_MEASURES} FROM savings GROUP BY 1 ORDER BY tokens_saved DESC, original_cmd LIMIT 15",
    "savings_sessions": f" SELECT count(DISTINCT session_id) AS sessions, coalesce(sum({_SAVED}) FILTER (session_id IS NOT NULL), 0)::BIGINT AS tagged_saved, count(*) FILTER (session_id IS NULL) AS untagged, round(coalesce(sum({_SAVED}) FILTER (session_id IS NOT NULL), 0)::DOUBLE / greatest(count(DISTINCT session_id), 1), 6) AS avg_saved_per_session FROM savings",
    "savings_weighted": f" SELECT round(sum({_SAVED}) * 100.0 / sum(raw_tokens), 6) AS weighted_savings_pct FROM savings",
    "savings_cost": f" SELECT tier, tokens_saved, round(tokens_saved / 1e6 * price, 6) AS dollars FROM (SELECT sum({_SAVED})::BIGINT AS tokens_saved FROM savings), (VALUES ('economy', 1.0), ('standard', 3.0), ('premium', 5.0), ('flagship', 15.0)) t(tier, price)",
    "savings_prune": f" SELECT event_id, timestamp FROM savings WHERE timestamp >= {1_714_000_000 - 90 * 86400}",
    "savings_clean": " SELECT event_id, raw_tokens, compressed_tokens FROM savings WHERE compressed_tokens <= raw_tokens",
    "savings_rollup": f" SELECT day, command_type, sum(x)::BIGINT AS tokens_saved, count(*) AS invocations FROM (SELECT strftime(to_timestamp(timestamp) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, command_type, {_SAVED} AS x FROM savings) GROUP BY ROLLUP (day, command_type)",
    "history_churn": " SELECT path, count(*) AS touches, round(count(*)::DOUBLE / (SELECT count(*) FROM commits), 9) AS churn_rate FROM touches GROUP BY path",
    "history_file_risk": _RISK + " SELECT * FROM risk",
    "history_temporal_stats": f" SELECT path, count(*) AS commits, count(*) FILTER (is_fix) AS fixes, count(*) FILTER (days <= 30) AS changes_30d, count(*) FILTER (days <= 90) AS changes_90d FROM (SELECT DISTINCT hash, path, is_fix, greatest({NOW} - greatest(ts, 0), 0) / 86400.0 AS days FROM touches) GROUP BY path",
    "history_cochange": _PAIRS + " SELECT * FROM co",
    "history_partners": _PAIRS + " SELECT * FROM partners",
    "history_coupling": _coupling(0.5, 3) + " SELECT * FROM edges",
    "history_coupling_wide": _coupling(0.02, 1) + " SELECT * FROM edges",
    "history_blast_radius": _coupling(0.5, 3) + " SELECT * FROM radius",
    "history_stability": _STABILITY + " SELECT * FROM stab",
    "history_authors": _AUTHORS + " SELECT * FROM auth",
    "history_fix_after_touch": _fixes(5) + " SELECT * FROM fixes",
    "history_fix_after_touch_wide": _fixes(500) + " SELECT * FROM fixes",
    "history_encapsulation": _MODULES + " SELECT * FROM enc",
    "history_top_hotspots": _RISK + " SELECT * FROM risk ORDER BY score DESC, path LIMIT 20",
    "history_top_coldspots": _RISK + " SELECT * FROM risk ORDER BY score, path LIMIT 20",
    "history_top_risks": _RISK + " SELECT * FROM risk ORDER BY risk_score DESC, path LIMIT 20",
    "history_scope": _TARGETS + " SELECT path, count(*) AS touches, round(count(*)::DOUBLE / (SELECT count(*) FROM commits), 9) AS churn_rate FROM touches WHERE path IN (SELECT path FROM targets) GROUP BY path",
    "history_missing": _TARGETS + " SELECT path FROM targets WHERE path NOT IN (SELECT path FROM touches)",
    "history_resort_partners": _RISK + _PAIRS + " SELECT partner, count, jaccard, coalesce(score, 0) AS score FROM (SELECT * FROM partners ORDER BY jaccard DESC, partner LIMIT 100) LEFT JOIN risk ON path = partner ORDER BY coalesce(score, 0) DESC, jaccard DESC, partner LIMIT 20",
    "history_annotate_risky": _RISK + _TARGETS + " SELECT path, coalesce(risk_score, -1) AS history_score FROM targets LEFT JOIN risk USING (path)",
    "history_annotate": _RISK + _TARGETS + " SELECT path, coalesce(score, -1) AS history_score FROM targets LEFT JOIN risk USING (path)",
    "history_window_start": f", newest AS (SELECT ts FROM commits ORDER BY ts DESC, hash LIMIT 200), nth AS (SELECT CASE WHEN count(*) = 200 AND min(ts) > 0 THEN min(ts) END AS nth FROM newest) SELECT least({NOW - 90 * 86400}, coalesce(nth, {NOW}))::BIGINT AS since, nth, NULL::VARCHAR AS warning FROM nth",
    "history_window_last": " SELECT min(ts) AS since, min(ts) AS nth, 'several windows' AS warning FROM (SELECT ts FROM commits ORDER BY ts DESC LIMIT 500) HAVING count(*) = 500 UNION ALL SELECT NULL, NULL, 'too few commits' FROM (SELECT count(*) AS n FROM commits) WHERE n < 500",
    "history_window_preset": f" SELECT {NOW - 180 * 86400}::BIGINT AS since, NULL::BIGINT AS nth, NULL::VARCHAR AS warning",
    "history_split": " SELECT hash, row_number() OVER (ORDER BY ts, hash) <= greatest(1, least(count(*) OVER () - 1, floor(count(*) OVER () * 0.8))) AS train FROM commits",
    "history_quality_gate": " SELECT multi, round(span, 6) AS span_days, multi >= 50 AND (n < 2 OR span >= 180) AS passed FROM (SELECT count(*) FILTER (n >= 2) AS multi FROM (SELECT count(DISTINCT path) AS n FROM touches GROUP BY hash)), (SELECT (max(ts) - min(ts)) / 86400.0 AS span, count(*) AS n FROM commits)",
    "history_dense_ids": " SELECT path, row_number() OVER (ORDER BY path) - 1 AS file_id FROM (SELECT DISTINCT path FROM touches)",
    "history_fix_commits": " SELECT hash, hash % 3 <> 1 AS is_fix FROM commits",
}
ORACLES = {k: with_views(v) for k, v in ORACLES.items()}
_PARTS = _coupling(0.5, 3) + _STABILITY + _AUTHORS + _fixes(5) + _MODULES + _HEATMAP
ORACLES |= {
    "history_without_excluded": with_kept_views(" SELECT path, count(*) AS touches, round(count(*)::DOUBLE / (SELECT count(*) FROM commits), 9) AS churn_rate FROM touches GROUP BY path"),
    "history_heatmap": with_kept_views(_PARTS + " SELECT * FROM heat"),
    "history_insights": with_kept_views(_PARTS + """
, found AS (
  SELECT 'stability' AS kind, path AS subject, NULL::VARCHAR AS detail, stability::DOUBLE AS value, CASE WHEN stability < 40 THEN 'critical' WHEN stability < 70 THEN 'warning' END AS severity FROM heat
  UNION ALL SELECT 'fix_risk', path, NULL, combined_pct, CASE WHEN combined_pct > 50 THEN 'critical' WHEN combined_pct > 30 THEN 'warning' END FROM heat WHERE NOT insufficient
  UNION ALL SELECT 'encapsulation', module, NULL, encapsulation_pct, CASE WHEN encapsulation_pct < 40 THEN 'critical' WHEN encapsulation_pct < 60 THEN 'warning' END FROM enc
  UNION ALL SELECT 'coupling', path, other, confidence, CASE WHEN confidence > 0.8 THEN 'warning' END FROM radius
  UNION ALL SELECT 'single_owner', path, NULL, top_author_pct, CASE WHEN top_author_pct > 80 THEN 'warning' END FROM heat
) SELECT kind, subject, detail, round(value, 6) AS value, severity FROM found WHERE severity IS NOT NULL"""),
}
