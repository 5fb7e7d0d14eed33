"""Registered queries of lexical search and retrieval evaluation with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import evaluation as ev
from brindle.operators import history as h
from brindle.operators import lexical as lx
from brindle.plans.views import commits, table, touches, with_views
from brindle.sources import scratch
from brindle.sources.sinks import write_lexical_index

QUERY = "nation the border"
KEYS = [QUERY.encode()[i : i + 2].hex().upper() for i in range(len(QUERY) - 1)]


def files(spark, sf_dir):
    """Documents as files: bytes up to 200 count as a type definition, up to 600 as body, the rest as other."""
    n = F.octet_length("text")
    cut = lambda a, b, f: F.struct(F.lit(a).cast("int").alias("start"), F.least(n, b).cast("int").alias("end"), F.lit(f).cast("int").alias("field"))
    ranges = F.filter(F.array(cut(0, F.lit(200), 0), cut(200, F.lit(600), 4), cut(600, n, 7)), lambda r: r["start"] < r["end"])
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), "lang", ranges.alias("field_map"))


def index(sp, d) -> lx.Index:
    """The stored index of the documents, written at the first search of a session and whenever their files change."""
    path = f"{scratch.shared_dir(sp).rstrip('/')}/lexical-{scratch.signature(sp, f'{d}/documents.parquet')}"
    if scratch.exists(sp, f"{path}/corpus_stats/_SUCCESS"):
        return lx.Index(sp, path)
    scratch.keep_until_end(sp, path)
    return write_lexical_index(files(sp, d), path)


def _filtered(sp, d):
    """English documents of more than one line that hold a digit."""
    f = files(sp, d)
    allow = lx.intersect([f.filter(F.col("content").contains("\n")), f.filter(F.col("content").rlike("[0-9]"))])
    return lx.ranked(index(sp, d).search(KEYS, lx.STRUCTURAL, allow, "en"), 20, 5)


def _ranked(sp, d):
    li = table(sp, d, "lineitem").groupBy(F.col("l_orderkey").alias("query"), F.col("l_partkey").alias("doc_id")).agg(F.sum("l_quantity").alias("score"))
    return lx.rank_column(li, "query")


def _qrels(sp, d):
    return table(sp, d, "lineitem").filter("l_linenumber = 2").select(F.col("l_orderkey").alias("query"), F.col("l_partkey").alias("doc_id")).distinct()


def _cochange_eval(sp, d):
    split = scratch.written(h.split(commits(sp, d)), "split")
    return ev.predict_cochange(touches(sp, d).select("hash", "path").join(split, "hash"), (0.01, 0.02, 0.05))


def _selectivity(sp, d):
    """item_id, query, selectivity of every benchmark item; its whole text is the query. 0 for texts without a bigram."""
    items = table(sp, d, "benchmark").select("item_id", F.col("text").alias("query"))
    sums = lx.selectivity(items.select("query").distinct(), index(sp, d).weights())
    return items.join(sums, "query", "left").select("item_id", "query", F.round(F.coalesce("selectivity", F.lit(0.0)), 3).alias("selectivity"))


QUERIES = {
    "search_index": lambda sp, d: index(sp, d).read("terms").agg(F.count("*").alias("terms"), F.count_distinct("key").alias("keys"), *(F.sum(f"tf_{f}").alias(f"tf_{f}") for f in (0, 4, 7))),
    "search_bm25f": lambda sp, d: lx.ranked(index(sp, d).search(KEYS), 50),
    "search_filtered": _filtered,
    "search_text": lambda sp, d: lx.ranked(index(sp, d).search_text(QUERY)),
    "search_without_index": lambda sp, d: lx.ranked(lx.search(files(sp, d), KEYS, lx.idf(lx.document_frequency(files(sp, d), KEYS))), 50),
    "search_idf": lambda sp, d: index(sp, d).weights().select("key", "df", F.round("idf", 5).alias("idf")),
    "search_weight_table": lambda sp, d: lx.weight_table(index(sp, d).read("df"), 3.0).select("key", "df", F.round("idf", 5).alias("idf")),
    "search_term_frequency": lambda sp, d: lx.term_frequency(lx.postings(files(sp, d), KEYS[:4])),
    "search_file_meta": lambda sp, d: index(sp, d).read("file_meta"),
    "search_corpus_stats": lambda sp, d: index(sp, d).read("corpus_stats").select("n_files", *(F.round(f"avg_{f}", 6).alias(f"avg_{f}") for f in range(8))),
    "search_selectivity": _selectivity,
    "search_context": lambda sp, d: files(sp, d).select("doc_id", lx.line_of(F.col("content"), F.lit(120)).alias("line"), F.md5(lx.context(F.col("content"), lx.line_of(F.col("content"), F.lit(120))).cast("binary")).alias("context")),
    "eval_ranking": lambda sp, d: ev.ranking_metrics(_ranked(sp, d), _qrels(sp, d)),
    "eval_hash_split": lambda sp, d: table(sp, d, "benchmark").select("item_id", ev.hash_split(F.col("text")).alias("split")),
    "eval_cochange": _cochange_eval,
}

_BIG = """
files AS (SELECT doc_id, text AS content, lang, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents
), meta AS (SELECT doc_id, lang, n AS doc_length, least(n, 200) AS len_0, 0 AS len_1, 0 AS len_2, 0 AS len_3, greatest(least(n, 600) - 200, 0) AS len_4, 0 AS len_5, 0 AS len_6, greatest(n - 600, 0) AS len_7 FROM files
), stats AS (SELECT count(*) AS n_files, avg(len_0) AS avg_0, avg(len_4) AS avg_4, avg(len_7) AS avg_7 FROM meta
), grams AS (SELECT doc_id, i AS pos, substr(h, 2 * i + 1, 4) AS key FROM (SELECT doc_id, h, unnest(range(0, n - 1)) AS i FROM files)
), uniq AS (SELECT min(doc_id) AS doc_id FROM files GROUP BY content
), dfs AS (SELECT key, count(DISTINCT doc_id) AS df FROM grams WHERE doc_id IN (SELECT doc_id FROM uniq) GROUP BY key
), idf AS (SELECT key, df, (ln((SELECT count(*) FROM uniq)::DOUBLE / (df + 1))::FLOAT + 1::FLOAT)::DOUBLE AS idf FROM dfs
), tf AS (SELECT key, doc_id, count(*) FILTER (pos < 200) AS tf_0, count(*) FILTER (pos BETWEEN 200 AND 599) AS tf_4, count(*) FILTER (pos >= 600) AS tf_7 FROM grams GROUP BY key, doc_id
)
"""
_Q = ", q AS (SELECT key, count(*) AS times FROM (SELECT unnest([" + ", ".join(f"'{k}'" for k in KEYS) + "]) AS key) GROUP BY key)"


def _scored(boosts: dict[int, float]) -> str:
    w = " + ".join(f"{b} * tf_{i} / (0.25 + 0.75 * len_{i} / CASE WHEN avg_{i} > 0 THEN avg_{i} ELSE 1 END)" for i, b in boosts.items())
    return f""", w AS (SELECT doc_id, lang, times, coalesce(idf, ln(n_files) + 1) AS idf, tf_0 * times AS t_0, tf_4 * times AS t_4, tf_7 * times AS t_7, {w} AS w FROM tf JOIN q USING (key) LEFT JOIN idf USING (key) JOIN meta USING (doc_id), stats
), scored AS (SELECT doc_id, any_value(lang) AS lang, round(sum(times * idf * w / (w + 1.2)), 6) AS score, CASE WHEN sum(t_0) >= sum(t_4) AND sum(t_0) >= sum(t_7) THEN 0 WHEN sum(t_4) >= sum(t_7) THEN 4 ELSE 7 END AS field FROM w GROUP BY doc_id)"""


_SPLIT = ", part_of AS (SELECT hash, row_number() OVER (ORDER BY ts, hash) <= greatest(1, least(count(*) OVER () - 1, floor(count(*) OVER () * 0.8))) AS train FROM commits)"
ORACLES = {
    "search_without_index": "WITH " + _BIG + _Q + _scored({0: 5.0, 4: 1.0, 7: 1.0}) + " SELECT doc_id, score, field FROM scored ORDER BY score DESC, doc_id LIMIT 50",
    "search_bm25f": "WITH " + _BIG + _Q + _scored({0: 5.0, 4: 1.0, 7: 1.0}) + " SELECT doc_id, score, field FROM scored ORDER BY score DESC, doc_id LIMIT 50",
    "search_filtered": "WITH " + _BIG + _Q + _scored({0: 3.0, 4: 1.0, 7: 1.0}) + " SELECT doc_id, score, field FROM scored WHERE lang = 'en' AND doc_id IN (SELECT doc_id FROM documents WHERE contains(text, chr(10)) AND regexp_matches(text, '[0-9]')) ORDER BY score DESC, doc_id LIMIT 20 OFFSET 5",
    "search_idf": "WITH " + _BIG + " SELECT key, df, round(idf, 5) AS idf FROM idf",
    "search_weight_table": "WITH " + _BIG + " SELECT key, df, round(idf, 5) AS idf FROM idf WHERE idf >= 3.0",
    "search_term_frequency": "WITH " + _BIG + f" SELECT key, doc_id, tf_0, 0 AS tf_1, 0 AS tf_2, 0 AS tf_3, tf_4, 0 AS tf_5, 0 AS tf_6, tf_7 FROM tf WHERE key IN ({', '.join(repr(k) for k in KEYS[:4])})",
    "search_file_meta": "WITH " + _BIG + " SELECT * FROM meta",
    "search_corpus_stats": "WITH " + _BIG + " SELECT n_files, round(avg_0, 6) AS avg_0, 0.0 AS avg_1, 0.0 AS avg_2, 0.0 AS avg_3, round(avg_4, 6) AS avg_4, 0.0 AS avg_5, 0.0 AS avg_6, round(avg_7, 6) AS avg_7 FROM stats",
    "search_selectivity": "WITH " + _BIG + ", qg AS (SELECT item_id, substr(hex(encode(text)), 2 * i + 1, 4) AS key FROM (SELECT item_id, text, unnest(range(0, octet_length(encode(text)) - 1)) AS i FROM benchmark)), sums AS (SELECT item_id, sum(coalesce(idf, 0)) AS s FROM qg LEFT JOIN idf USING (key) GROUP BY item_id) SELECT item_id, text AS query, round(coalesce(s, 0), 3) AS selectivity FROM benchmark LEFT JOIN sums USING (item_id)",
    "search_index": "WITH " + _BIG + " SELECT count(*) AS terms, count(DISTINCT key) AS keys, sum(tf_0)::BIGINT AS tf_0, sum(tf_4)::BIGINT AS tf_4, sum(tf_7)::BIGINT AS tf_7 FROM tf",
    "search_context": r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines, (length(substr(hex(encode(text)), 1, 240)) - length(regexp_replace(substr(hex(encode(text)), 1, 240), '^((?:..)*?)0A', '\1'))) AS x, text FROM documents),
      k AS (SELECT doc_id, lines, len(list_filter(range(0, least(120, octet_length(encode(text)))), lambda i: substr(hex(encode(text)), 2 * i + 1, 2) = '0A')) + 1 AS line FROM l)
      SELECT doc_id, line, md5(array_to_string(lines[greatest(line - 3, 1):line + 3], chr(10))) AS context FROM k""",
    "eval_ranking": """WITH r AS (SELECT query, doc_id, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank FROM (SELECT l_orderkey AS query, l_partkey AS doc_id, sum(l_quantity) AS score FROM lineitem GROUP BY 1, 2)),
      q AS (SELECT DISTINCT l_orderkey AS query, l_partkey AS doc_id FROM lineitem WHERE l_linenumber = 2),
      f AS (SELECT q.query, min(rank) AS rank FROM q LEFT JOIN r USING (query, doc_id) GROUP BY 1)
      SELECT round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, count(*) FILTER (rank = 1) AS rank_1, count(*) AS queries, round((SELECT count(*) FILTER (rank <= 5) FROM r JOIN q USING (query, doc_id)) / 5.0 / count(*), 6) AS p_at_5, round((SELECT count(*) FILTER (rank <= 10) FROM r JOIN q USING (query, doc_id)) / 10.0 / count(*), 6) AS p_at_10 FROM f""",
    "eval_hash_split": "SELECT item_id, CASE WHEN ('0x' || substr(sha256(text), 1, 2))::INT % 5 < 3 THEN 'train' ELSE 'test' END AS split FROM benchmark",
    "eval_cochange": with_views(_SPLIT + """
, tr AS (SELECT DISTINCT hash, path FROM touches JOIN part_of USING (hash) WHERE train AND hash IN (SELECT hash FROM touches GROUP BY hash HAVING count(*) <= 50)
), nf AS (SELECT path, count(*) AS n FROM tr GROUP BY path
), pr AS (SELECT a.path AS fa, b.path AS fb, count(*) AS c FROM tr a JOIN tr b ON a.hash = b.hash AND a.path <> b.path GROUP BY 1, 2
), ja AS (SELECT fa, fb, round(c::DOUBLE / (x.n + y.n - c), 6) AS j FROM pr JOIN nf x ON x.path = fa JOIN nf y ON y.path = fb
), te AS (SELECT DISTINCT hash, path FROM touches JOIN part_of USING (hash) WHERE NOT train AND path IN (SELECT path FROM touches JOIN part_of USING (hash) WHERE train)
), sz AS (SELECT hash, count(*) AS n FROM te GROUP BY hash HAVING count(*) BETWEEN 2 AND 500
), th AS (SELECT unnest([0.01, 0.02, 0.05]::DOUBLE[]) AS threshold
), each AS (SELECT threshold, te.hash, te.path, n - 1 AS a, count(j) AS p, count(o.path) AS h FROM te JOIN sz USING (hash) CROSS JOIN th LEFT JOIN ja ON fa = te.path AND j >= threshold LEFT JOIN te o ON o.hash = te.hash AND o.path = fb GROUP BY 1, 2, 3, 4
), per AS (SELECT threshold, hash, avg(coalesce(h / nullif(p, 0), 0)) AS mp, avg(h / a) AS mr, sum(h) AS h, sum(p) AS p, sum(a) AS a FROM (SELECT threshold, hash, a::DOUBLE AS a, p::DOUBLE AS p, h::DOUBLE AS h FROM each) GROUP BY 1, 2
), al AS (SELECT threshold, count(*) AS commits, coalesce(sum(h) / nullif(sum(p), 0), 0) AS up, sum(h) / sum(a) AS ur, avg(mp) AS mp, avg(mr) AS mr FROM per GROUP BY 1
) SELECT threshold, commits, round(up, 6) AS micro_precision, round(ur, 6) AS micro_recall, round(coalesce(2 * up * ur / nullif(up + ur, 0), 0), 6) AS micro_f1, round(mp, 6) AS macro_precision, round(mr, 6) AS macro_recall, round(coalesce(2 * mp * mr / nullif(mp + mr, 0), 0), 6) AS macro_f1 FROM al"""),
}
