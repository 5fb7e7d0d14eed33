"""The registered queries of the text operators, each over its whole table, and DuckDB SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import bpe, fingerprint, jaccard, matroska, mixing, pii, quotes, toxicity, url_filter
from brindle.llm.common import materialise, table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op2_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.digest(materialise(matroska.store(table(spark, sf_dir, "documents")), "media"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sample(table(spark, sf_dir, "documents")).drop("epochs")


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.component_table(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_table(table(spark, sf_dir, "documents"))


def op6_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link(table(spark, sf_dir, "conversations"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_table(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.train(docs))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.count_table(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_url_filter, op2_matroska, op3_mixing, op4_jaccard, op5_bpe, op6_quotes, op7_toxicity, op8_fingerprint, op9_pii, op10_token_counts)
}

_OP3 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents
), k AS (
  SELECT doc_id, size, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
         -ln((('0x' || substr(md5(concat_ws('|', '17', coalesce(doc_id::VARCHAR, ''), text)), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
         / greatest(0.05, len(list_distinct(lines))::DOUBLE / len(lines) * CASE WHEN length(text)::DOUBLE / greatest(size, 1) BETWEEN 3 AND 15 THEN 1.0 ELSE 0.5 END) AS key
  FROM d
), s AS (
  SELECT skey, sum(size)::BIGINT AS source_size, ([5.0, 2.0, 1.0])[((row_number() OVER (ORDER BY skey) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM k GROUP BY skey
), water AS (  -- one round for each set of sources that reach three times their size
  SELECT 0 AS round, skey, source_size, w, FALSE AS capped, 0::DOUBLE AS level FROM s
  UNION ALL
  SELECT round + 1, skey, source_size, w, capped OR level * w > 3.0 * source_size, level
  FROM (
    SELECT round, skey, source_size, w, capped,
           (sum(source_size) OVER () - sum(CASE WHEN capped THEN 3.0 * source_size ELSE 0 END) OVER ())::DOUBLE / nullif(sum(CASE WHEN capped THEN 0 ELSE w END) OVER (), 0) AS level
    FROM water
  ) WHERE round <= (SELECT count(*) FROM s)
), last_round AS (
  SELECT skey, source_size, w, capped,
         (sum(source_size) OVER () - sum(CASE WHEN capped THEN 3.0 * source_size ELSE 0 END) OVER ())::DOUBLE / nullif(sum(CASE WHEN capped THEN 0 ELSE w END) OVER (), 0) AS level
  FROM water WHERE round = (SELECT max(round) FROM water)
), t AS (
  SELECT skey, source_size, least(3.0 * source_size, CASE WHEN capped OR level IS NULL THEN 3.0 * source_size ELSE level * w END)::DOUBLE AS target FROM last_round
), e AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size)::BIGINT END AS epochs FROM t
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (epochs * size + greatest(0, least(size, round(target - epochs * source_size)::BIGINT - (sum(size) OVER (PARTITION BY skey ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size))))::BIGINT AS taken
FROM k JOIN e USING (skey)
"""

_OP4 = r"""
WITH RECURSIVE w AS (
  SELECT rowid AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)
), x AS (
  SELECT DISTINCT r, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
         ELSE list_transform(generate_series(1, len(words) - 2), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS g
  FROM w
), n AS (SELECT r, count(*) AS n FROM x GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS i FROM x a JOIN x b ON a.g = b.g AND a.r <> b.r GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 100 * i >= 90 * (na.n + nb.n - i)),
reach AS (SELECT r AS a, r AS b FROM w UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (r) JOIN (SELECT a, min(v.doc_id) AS component_id FROM reach JOIN w v ON v.r = reach.b GROUP BY a) c ON c.a = w.r
"""

ORACLES: dict[str, str] = {"op3_mixing": _OP3, "op4_jaccard": _OP4}
