"""Relations of the engine derived from the star-schema tables, as DataFrames and as DuckDB common table expressions.

commits come from orders, touches from their line items, savings records from events, files from documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The clock of queries that look back from "now"; some commits lie after it.
NOW = 1_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(col: str) -> F.Column:
    """Seconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({col} AS TIMESTAMP_NTZ))")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("hash"), epoch("o_orderdate").alias("ts"), F.col("o_custkey").alias("author"),
        F.col("o_orderpriority").alias("message"), (F.col("o_orderpriority") == "1-URGENT").alias("is_fix"),
    )


def touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files are named by brand and part; some lie in no folder, some in a vendored one, and some have a test that goes with them."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.col("l_quantity").cast("bigint").alias("additions"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    files = li.join(part, li.l_partkey == part.p_partkey)
    k = F.col("l_partkey")
    name = F.when(k % 17 == 0, F.concat(F.lit("note"), k.cast("string"), F.lit(".md"))).when(k % 23 == 0, F.concat(F.lit("vendor/"), k.cast("string"))).otherwise(F.concat_ws("/", "p_brand", "l_partkey"))
    paths = F.when(k % 5 == 0, F.array(name, F.concat(F.lit("tests/t"), k.cast("string")))).otherwise(F.array(name))
    files = files.select(F.col("l_orderkey").alias("hash"), F.explode(paths).alias("path"), "additions")
    return files.join(commits(spark, sf_dir), "hash")


def savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    return e.select(
        epoch("ts").alias("timestamp"), F.col("event_type").alias("command_type"),
        F.concat_ws(" ", "event_type", (i % 23).cast("string")).alias("original_cmd"),
        (F.floor(F.col("value") * 10) + i % 100).cast("bigint").alias("raw_tokens"),
        (F.floor(F.col("value") * 4) + (i * 7) % 150).cast("bigint").alias("compressed_tokens"),
        (i % 500).alias("duration_ms"), F.concat(F.lit("/p/"), (i % 3).cast("string")).alias("project_path"),
        F.element_at(F.array(F.lit("rust"), F.lit("python"), F.lit("go"), F.lit(None)), (i % 4 + 1).cast("int")).alias("language"),
        F.element_at(F.array(F.lit("structure"), F.lit("signatures"), F.lit(None)), (i % 3 + 1).cast("int")).alias("mode"),
        F.element_at(F.array(F.lit("full"), F.lit("degraded"), F.lit("passthrough"), F.lit("full"), F.lit(None)), (i % 5 + 1).cast("int")).alias("parse_tier"),
        F.when(i % 6 > 0, F.concat(F.lit("s"), F.col("user_id").cast("string"))).alias("session_id"), i.alias("event_id"),
    )


SQL = f"""
commits AS (
  SELECT o_orderkey AS hash, epoch(o_orderdate)::BIGINT AS ts, o_custkey AS author, o_orderpriority AS message, o_orderpriority = '1-URGENT' AS is_fix FROM orders
), touches AS (
  SELECT c.*, unnest(CASE WHEN l_partkey % 5 = 0 THEN [name, 'tests/t' || l_partkey] ELSE [name] END) AS path, l_quantity::BIGINT AS additions
  FROM (SELECT *, CASE WHEN l_partkey % 17 = 0 THEN 'note' || l_partkey || '.md' WHEN l_partkey % 23 = 0 THEN 'vendor/' || l_partkey ELSE p_brand || '/' || l_partkey END AS name FROM lineitem JOIN part ON p_partkey = l_partkey) JOIN commits c ON c.hash = l_orderkey
), savings AS (
  SELECT floor(epoch(ts))::BIGINT AS timestamp, event_type AS command_type, event_type || ' ' || (event_id % 23) AS original_cmd,
    (floor(value * 10) + event_id % 100)::BIGINT AS raw_tokens, (floor(value * 4) + (event_id * 7) % 150)::BIGINT AS compressed_tokens,
    event_id % 500 AS duration_ms, '/p/' || (event_id % 3) AS project_path, (['rust', 'python', 'go', NULL])[(event_id % 4 + 1)::INT] AS language,
    (['structure', 'signatures', NULL])[(event_id % 3 + 1)::INT] AS mode, (['full', 'degraded', 'passthrough', 'full', NULL])[(event_id % 5 + 1)::INT] AS parse_tier,
    CASE WHEN event_id % 6 > 0 THEN 's' || user_id END AS session_id, event_id
  FROM events
), clock AS (SELECT {NOW}::BIGINT AS now)
"""


def with_views(sql: str) -> str:
    """DuckDB SQL over the derived relations. The text may begin with further CTEs, as ``, name AS (...) SELECT``."""
    return f"WITH {SQL.strip()} {sql}"


def with_kept_views(sql: str) -> str:
    """As ``with_views``, where touches lacks excluded paths and commits those that are left without a file."""
    every = SQL.strip().replace("commits AS (", "every_commit AS (", 1).replace("), touches AS (", "), every_touch AS (", 1).replace("JOIN commits c", "JOIN every_commit c")
    kept = ", touches AS (SELECT * FROM every_touch WHERE NOT starts_with(path, 'vendor/')), commits AS (SELECT * FROM every_commit WHERE hash IN (SELECT hash FROM touches))"
    return f"WITH {every} {kept} {sql}"
