"""Writers: index tables, history tables, savings records, manifests, results as JSON. Parquet commits make each write atomic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators import lexical

MAX_COMMAND_BYTES = 500


def cut_bytes(text: Column, most: int) -> Column:
    """The longest beginning of ``text`` of at most ``most`` UTF-8 bytes, on a character boundary."""
    head = F.substring(F.encode(text, "UTF-8"), 1, most + 1)
    at = lambda i: F.conv(F.hex(F.substring(head, i, 1)), 16, 10).cast("int")
    cut = F.when(~at(most + 1).between(128, 191), most)
    for back in range(1, 4):
        cut = cut.when(~at(most + 1 - back).between(128, 191), most - back)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.substring(head, F.lit(1), cut), "UTF-8"))


def write_lexical_index(files: DataFrame, path: str) -> lexical.Index:
    """terms, file_meta, df and corpus_stats below ``path``, the last one last: an index with it is whole.

    Terms are dealt by (key, document) ranges, so a key that every document holds goes to many files, and sorted, so that a
    search skips the row groups of other keys.
    """
    lexical.term_counts(files).repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id").write.mode("overwrite").parquet(f"{path}/terms")
    lexical.file_meta(files).write.mode("overwrite").parquet(f"{path}/file_meta")
    lexical.document_frequency(files).repartition(1).sortWithinPartitions("key").write.mode("overwrite").parquet(f"{path}/df")  # 65,536 rows at most
    index = lexical.Index(files.sparkSession, path)
    lexical.corpus_stats(index.read("file_meta")).write.mode("overwrite").parquet(f"{path}/corpus_stats")
    return index


def write_structural_index(grams: DataFrame, path: str) -> None:
    """N-gram counts (doc_id, gp, p, c, count), pairs and triples apart, sorted by their kinds."""
    kind = F.when(F.col("gp").isNull(), "bigram").otherwise("trigram")
    grams.withColumn("kind", kind).repartitionByRange("kind", "p", "c").sortWithinPartitions("kind", "p", "c", "doc_id").write.mode("overwrite").partitionBy("kind").parquet(f"{path}/ast_postings")


def write_cochange(pairs: DataFrame, path: str) -> None:
    pairs.repartitionByRange("file_a", "file_b").sortWithinPartitions("file_a", "file_b").write.mode("overwrite").parquet(f"{path}/cochange")


def write_history(tables: dict[str, DataFrame], path: str, most: int | None = None) -> None:
    """Replace each table. With ``most``, one with more rows raises before anything is written."""
    for name, df in tables.items() if most is not None else ():
        if df.limit(most + 1).count() > most:
            raise ValueError(f"{name} has more than {most} rows")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def record_savings(records: DataFrame, path: str) -> None:
    """Append; the original command is cut to 500 bytes and session ids that are not safe are dropped."""
    from brindle.functions.text import safe_session

    rows = records.withColumn("original_cmd", cut_bytes(F.col("original_cmd"), MAX_COMMAND_BYTES))
    if "session_id" in rows.columns:
        rows = rows.withColumn("session_id", F.when(safe_session(F.col("session_id")), F.col("session_id")))
    rows.write.mode("append").parquet(path)


def manifest(files: DataFrame) -> DataFrame:
    """path, sha256, lang, n_bytes of files (path, content, lang), and their field map if they carry one."""
    more = ["field_map"] if "field_map" in files.columns else []
    return files.select("path", F.sha2(F.encode("content", "UTF-8"), 256).alias("sha256"), "lang", F.octet_length("content").alias("n_bytes"), *more)


def as_json(results: DataFrame) -> DataFrame:
    """One JSON text a row."""
    return results.select(F.to_json(F.struct(*results.columns), {"ignoreNullFields": "false"}).alias("json"))


def tee_failures(outputs: DataFrame, path: str) -> None:
    """Append raw outputs (exit_code other than 0) as they came."""
    outputs.filter("exit_code <> 0").write.mode("append").parquet(path)


def cached_transform(files: DataFrame, path: str, mode: str) -> DataFrame:
    """doc_id, output of files (doc_id, content, lang) in a mode; what the cache at ``path`` holds for a content is not made again."""
    from brindle.functions.source_modes import transform_column

    spark = files.sparkSession
    rows = files.withColumn("sha256", F.sha2(F.encode("content", "UTF-8"), 256)).withColumn("mode", F.lit(mode))
    known = spark.read.schema("sha256 string, lang string, mode string, output string").option("pathGlobFilter", "*.parquet").parquet(path)
    new = rows.join(known, ["sha256", "lang", "mode"], "left_anti").dropDuplicates(["sha256", "lang"]).select("sha256", "lang", "mode", transform_column(F.col("content"), F.col("lang"), mode).alias("output"))
    new.write.mode("append").parquet(path)
    known = spark.read.schema("sha256 string, lang string, mode string, output string").parquet(path).dropDuplicates(["sha256", "lang", "mode"])
    return rows.join(known, ["sha256", "lang", "mode"]).select("doc_id", "output")
