"""Ranked lexical search: byte bigrams scored by BM25F over eight fields.

files: doc_id, content, lang and optionally field_map (ranges of bytes with a field). Keys are bigrams as four hex digits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

FIELDS = ("type_def", "function_sig", "symbol", "import", "body", "comment", "string", "other")
OTHER = 7
MAX_QUERY_BYTES = 4096
BORDER_WEIGHT = 3.5


@dataclass(frozen=True)
class Config:
    """BM25F parameters; the values are the engine's fixed defaults."""

    k1: float = 1.2
    b: tuple[float, ...] = (0.75,) * 8
    boosts: tuple[float, ...] = (5.0, 4.0, 3.5, 3.0, 1.0, 0.8, 0.5, 1.0)

    def validate(self) -> None:
        """Raise ValueError unless k1 and boosts are finite and not negative and every b lies in 0..1."""
        values = (self.k1, *self.boosts)
        if any(not 0 <= v < float("inf") for v in values) or any(not 0 <= v <= 1 for v in self.b) or len(self.b) != 8 or len(self.boosts) != 8:
            raise ValueError("BM25F parameters out of range")


UNIFORM = Config(boosts=(1.0,) * 8)
STRUCTURAL = Config(boosts=(3.0, 3.0, 3.0, 3.0, 1.0, 1.0, 1.0, 1.0))


def _hex(content: Column) -> Column:
    return F.hex(F.encode(content, "UTF-8"))


def _bigrams(content: Column) -> Column:
    """Every overlapping byte bigram in order; array access keeps this linear in the text."""
    octets = F.regexp_extract_all(_hex(content), F.lit("(..)"), 1)
    n = F.greatest(F.octet_length(content) - 1, F.lit(0))
    return F.zip_with(F.slice(octets, F.lit(1), n), F.slice(octets, F.lit(2), n), lambda x, y: F.concat(x, y))


def bigram_positions(files: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """doc_id, key, pos of every overlapping byte bigram, or of those in ``keys`` only, filtered before rows are made."""
    pairs = F.transform(_bigrams(F.col("content")), lambda k, i: F.struct(k.alias("key"), i.alias("pos")))
    if keys is not None:
        pairs = F.filter(pairs, lambda p: p["key"].isin(keys) if keys else F.lit(False))
    return files.select("doc_id", *(["field_map"] if "field_map" in files.columns else []), F.explode(pairs).alias("p")).select("*", "p.key", "p.pos").drop("p")


def postings(files: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """doc_id, key, pos, field: the field of the first range that holds the position; other without one."""
    rows = bigram_positions(files, keys)
    if "field_map" not in files.columns:
        return rows.withColumn("field", F.lit(OTHER))
    hit = F.filter("field_map", lambda r: (r["start"] <= F.col("pos")) & (F.col("pos") < r["end"]))
    return rows.select("doc_id", "key", "pos", F.coalesce(F.try_element_at(hit, F.lit(1))["field"].cast("int"), F.lit(OTHER)).alias("field"))


def file_meta(files: DataFrame) -> DataFrame:
    """doc_id, lang, doc_length and the eight field lengths; without ranges all bytes are in other."""
    n = F.octet_length("content")
    if "field_map" in files.columns:
        part = lambda f: F.aggregate(F.filter("field_map", lambda r: r["field"] == f), F.lit(0).cast("bigint"), lambda a, r: a + r["end"] - r["start"])
        empty = F.coalesce(F.size("field_map"), F.lit(0)) <= 0
        lens = [F.when(empty, n if f == OTHER else F.lit(0)).otherwise(part(f)) for f in range(8)]
    else:
        lens = [n if f == OTHER else F.lit(0) for f in range(8)]
    return files.select("doc_id", "lang", n.cast("bigint").alias("doc_length"), *(x.cast("bigint").alias(f"len_{f}") for f, x in enumerate(lens)))


def corpus_stats(meta: DataFrame) -> DataFrame:
    return meta.agg(F.count("*").alias("n_files"), *(F.coalesce(F.avg(f"len_{f}"), F.lit(0.0)).alias(f"avg_{f}") for f in range(8)))


def _codes(content: str) -> np.ndarray:
    raw = np.frombuffer(content.encode(), np.uint8).astype(np.uint16)
    return (raw[:-1] << np.uint16(8)) | raw[1:]


def term_counts(files: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """key, doc_id, tf_0..tf_7 of every bigram of every file, or of those in ``keys``: what ``term_frequency(postings(files))`` gives,
    counted in Arrow batches without a row for each byte. Null contents have no bigram."""
    mapped = "field_map" in files.columns
    tf = [StructField(f"tf_{f}", LongType()) for f in range(8)]
    schema = StructType([StructField("key", StringType()), files.schema["doc_id"], *tf])
    arrow = to_arrow_schema(schema)
    wanted = None if keys is None else np.array(sorted({int(k, 16) for k in keys}), np.uint16)

    def run(it):
        for batch in it:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            maps = batch.column(2).to_pylist() if mapped else [None] * len(texts)
            owner, found, counts, size = [], [], [], 0
            for i, (text, ranges) in enumerate(zip(texts, maps, strict=True)):
                if text:
                    code = _codes(text)
                    field = np.full(len(code), OTHER, np.uint32)
                    for r in reversed(ranges or []):
                        field[max(0, r["start"]) : max(0, r["end"])] = r["field"]  # the first range that holds a position counts
                    if wanted is not None:
                        hit = np.isin(code, wanted)
                        code, field = code[hit], field[hit]
                    both, n = np.unique(code.astype(np.uint32) * 8 + field, return_counts=True)
                    owner.append(np.full(len(both), i))
                    found.append(both)
                    counts.append(n)
                    size += len(both)
                if size > 200_000 or (size and i == len(texts) - 1):
                    yield _count_rows(ids, np.concatenate(owner), np.concatenate(found), np.concatenate(counts), arrow)
                    owner, found, counts, size = [], [], [], 0

    return files.select("doc_id", "content", *(["field_map"] if mapped else [])).mapInArrow(run, schema)


def _count_rows(ids: pa.Array, owner: np.ndarray, found: np.ndarray, counts: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    pair, inverse = np.unique(owner.astype(np.uint64) << np.uint64(16) | (found >> 3).astype(np.uint64), return_inverse=True)
    tf = np.zeros((8, len(pair)), np.int64)
    tf[found & 7, inverse] = counts
    names = pa.array([f"{k:04X}" for k in (pair & np.uint64(0xFFFF)).tolist()])
    return pa.RecordBatch.from_arrays([names, ids.take(pa.array((pair >> np.uint64(16)).astype(np.int64))), *map(pa.array, tf)], schema=schema)


def document_frequency(files: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """key, df, n over files with distinct content; of ``keys`` only, where these are given. Counted within batches before the shuffle."""
    unique = files.select("content", F.sha2(F.col("content").cast("binary"), 256).alias("sha256")).dropDuplicates(["sha256"])
    wanted = None if keys is None else np.array(sorted({int(k, 16) for k in keys}), np.int64)
    schema = to_arrow_schema(StructType([StructField("key", StringType()), StructField("df", LongType())]))

    def run(it):
        total = np.zeros(1 << 16, np.int64)
        for batch in it:
            for text in batch.column(0).to_pylist():
                if text:
                    total[np.unique(_codes(text))] += 1
        some = np.flatnonzero(total) if wanted is None else wanted[total[wanted] > 0]
        yield pa.RecordBatch.from_arrays([pa.array([f"{k:04X}" for k in some.tolist()], pa.string()), pa.array(total[some])], schema=schema)

    rows = unique.select("content").mapInArrow(run, "key string, df bigint")
    total = unique.agg(F.count("*").alias("n")).withColumn("k", F.lit(1))
    return rows.groupBy("key").agg(F.sum("df").alias("df")).withColumn("k", F.lit(1)).join(F.broadcast(total), "k").select("key", "df", "n")


def idf(df: DataFrame) -> DataFrame:
    """key, df, idf: ln(n / (df + 1)) rounded to single precision, plus 1."""
    return df.select("key", "df", (F.log(F.col("n") / (F.col("df") + 1)).cast("float") + F.lit(1.0).cast("float")).cast("double").alias("idf"))


def weight_table(df: DataFrame, threshold: float) -> DataFrame:
    return idf(df).filter(F.col("idf") >= threshold).orderBy("key")


def selectivity(queries: DataFrame, weights: DataFrame) -> DataFrame:
    """query, selectivity: the sum of idf over a query's overlapping bigrams, 0 for unknown ones."""
    rows = bigram_positions(queries.select(F.col("query").alias("doc_id"), F.col("query").alias("content")))
    hits = rows.join(weights.select("key", "idf"), "key", "left")
    return hits.groupBy(F.col("doc_id").alias("query")).agg(F.round(F.sum(F.coalesce("idf", F.lit(0.0))), 6).alias("selectivity"))


def distinct_ngrams(queries: DataFrame, weights: DataFrame) -> DataFrame:
    """query, key, weight of queries (query): each of a query's distinct bigrams with its largest idf, 0 for unknown ones."""
    rows = bigram_positions(queries.select(F.col("query").alias("doc_id"), F.col("query").alias("content")))
    return rows.join(weights.select("key", "idf"), "key", "left").groupBy(F.col("doc_id").alias("query"), "key").agg(F.max(F.coalesce("idf", F.lit(0.0))).alias("weight"))


def term_frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("key", "doc_id").agg(*(F.count_if(F.col("field") == f).alias(f"tf_{f}") for f in range(8)))


def bm25f(config: Config) -> Column:
    """One key's contribution from tf_i, len_i, avg_i and idf."""
    w = F.lit(0.0)
    for i in range(8):
        avg = F.when(F.col(f"avg_{i}") > 0, F.col(f"avg_{i}")).otherwise(1.0)
        norm = 1 - config.b[i] + config.b[i] * F.col(f"len_{i}") / avg
        w = w + F.when(F.col(f"tf_{i}") > 0, config.boosts[i] * F.col(f"tf_{i}") / F.when(norm > 0, norm).otherwise(1.0)).otherwise(0.0)
    return F.col("idf") * w / (w + config.k1)


def dominant_field(tf: list[Column]) -> Column:
    """The field with the most occurrences; ties to the smallest, none at all to other."""
    best = F.array_max(F.array(*(F.struct(t.alias("n"), F.lit(-f).alias("f")) for f, t in enumerate(tf))))
    return F.when(best["n"] > 0, -best["f"]).otherwise(OTHER)


def intersect(filters: list[DataFrame]) -> DataFrame:
    """doc_id of documents that every one of the filter sets (each with doc_id) holds, once each."""
    out = filters[0].select("doc_id").distinct()
    for f in filters[1:]:
        out = out.join(f.select("doc_id"), "doc_id", "left_semi")
    return out


def _scored(tf: DataFrame, meta: DataFrame, stats: DataFrame, weights: DataFrame, times: dict[str, int], config: Config, default_idf: float | None) -> DataFrame:
    """doc_id, score, field of term counts; ``times`` says how often each key is asked for."""
    query = F.create_map(*(F.lit(x) for kv in times.items() for x in kv)) if times else F.create_map().cast("map<string,int>")
    default = F.lit(default_idf) if default_idf is not None else F.log("n_files") + 1
    known = F.broadcast(weights.filter(F.col("key").isin(sorted(times))).select("key", "idf"))  # at most one row a byte of the query
    rows = tf.join(known, "key", "left").join(meta, "doc_id")
    rows = rows.withColumn("k", F.lit(1)).join(F.broadcast(stats.withColumn("k", F.lit(1))), "k").withColumn("idf", F.coalesce("idf", default))
    scored = rows.groupBy("doc_id").agg(F.sum(bm25f(config) * F.element_at(query, F.col("key"))).alias("score"), *(F.sum(F.col(f"tf_{f}") * F.element_at(query, F.col("key"))).alias(f"t_{f}") for f in range(8)))
    return scored.select("doc_id", F.round("score", 6).alias("score"), dominant_field([F.col(f"t_{f}") for f in range(8)]).alias("field"))


def _allowed(meta: DataFrame, allow: DataFrame | None, lang: str | None) -> DataFrame:
    some = meta if lang is None else meta.filter(F.col("lang") == lang)
    return some if allow is None else some.join(allow.select("doc_id"), "doc_id", "left_semi")


def search(files: DataFrame, keys: list[str], weights: DataFrame, config: Config = Config(), allow: DataFrame | None = None, lang: str | None = None, default_idf: float | None = None) -> DataFrame:
    """doc_id, score, field of the files that hold any of ``keys``; a key listed twice counts twice.

    Without an index: one pass over the texts. Allow-list and language filters run before terms are counted; averages are
    those of all files.
    """
    config.validate()
    meta = file_meta(files)
    times = {k: keys.count(k) for k in keys}
    return _scored(term_counts(_allowed(files, allow, lang), sorted(times)), meta, corpus_stats(meta), weights, times, config, default_idf)


@dataclass(frozen=True)
class Index:
    """A stored index: terms (sorted by key, then document), file_meta, corpus_stats and df below ``path``. A search reads the row
    groups of its keys, never a text."""

    spark: SparkSession
    path: str

    def read(self, part: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{part}")

    def weights(self) -> DataFrame:
        return idf(self.read("df"))

    def terms(self, keys: list[str]) -> DataFrame:
        return self.read("terms").filter(F.col("key").isin(sorted(set(keys))))

    def search(self, keys: list[str], config: Config = Config(), allow: DataFrame | None = None, lang: str | None = None, default_idf: float | None = None) -> DataFrame:
        """As ``search`` over the indexed files."""
        config.validate()
        times = {k: keys.count(k) for k in keys}
        meta = _allowed(self.read("file_meta"), allow, lang)
        return _scored(self.terms(keys), meta, self.read("corpus_stats"), self.weights(), times, config, default_idf)

    def search_text(self, query: str, config: Config = Config(), **options) -> DataFrame:
        keys, default = query_keys(query, self.weights(), options.get("default_idf"))
        return self.search(keys, config, **options | {"default_idf": default})


def ranked(scores: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    return scores.orderBy(F.desc("score"), "doc_id").offset(offset).limit(limit)


def borders(query: bytes) -> list[tuple[int, int]]:
    """The first and last two bytes of each token; of a one-byte token, it and the byte before."""
    out, at = [], 0
    while at < len(query):
        if query[at : at + 1].isspace():
            at += 1
            continue
        end = at
        while end < len(query) and not query[end : end + 1].isspace():
            end += 1
        out += [(max(at - 1, 0), at + 1)] if end - at == 1 else [(at, at + 2), (end - 2, end)]
        at = end
    return out


def covering_set(query: str, weights: dict[str, float], default: float) -> list[tuple[str, float]]:
    """Bigrams in descending border-weighted order until every byte of the query is covered, each with its plain idf.

    Under two bytes nothing is searched; above MAX_QUERY_BYTES the query is refused.
    """
    raw = query.encode()
    if len(raw) > MAX_QUERY_BYTES:
        raise ValueError("query too long")
    near = {i for a, b in borders(raw) for i in range(a, b)}
    grams = [raw[i : i + 2].hex().upper() for i in range(len(raw) - 1)]
    plain = [weights.get(g, default) for g in grams]
    weight = [float(np.float32(p * BORDER_WEIGHT)) if i in near or i + 1 in near else p for i, p in enumerate(plain)]
    out, left = [], set(range(len(raw)))
    for i in sorted(range(len(grams)), key=lambda i: -weight[i]):
        if not left:
            break
        if left & {i, i + 1}:
            out.append((grams[i], plain[i]))
            left -= {i, i + 1}
    return out


def query_keys(query: str, weights: DataFrame, default: float | None = None) -> tuple[list[str], float]:
    """(covering set, idf of unknown keys) of a query text; on the driver, from the idf of its own bigrams only."""
    raw = query.encode()
    own = sorted({raw[i : i + 2].hex().upper() for i in range(len(raw) - 1)})
    known = {r.key: r.idf for r in weights.filter(F.col("key").isin(own)).select("key", "idf").collect()} if own else {}
    default = default or max([*known.values(), 1.0])
    return [k for k, _ in covering_set(query, known, default)], default


def search_text(files: DataFrame, query: str, weights: DataFrame, config: Config = Config(), **options) -> DataFrame:
    """Search for a text without an index."""
    keys, default = query_keys(query, weights, options.get("default_idf"))
    return search(files, keys, weights, config, **options | {"default_idf": default})


def context(content: Column, line: Column, around: int = 3) -> Column:
    """The lines around line number ``line`` (from 1), clamped to the text."""
    first = F.greatest(line - around, F.lit(1))
    return F.array_join(F.slice(F.split(content, "\n"), first, line + around - first + 1), "\n")


def line_of(content: Column, offset: Column) -> Column:
    """The line, from 1, of a byte offset."""
    head = F.decode(F.substring(F.encode(content, "UTF-8"), F.lit(1), offset.cast("int")), "ISO-8859-1")
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def rank_column(scores: DataFrame, partition: str) -> DataFrame:
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(partition).orderBy(F.desc("score"), "doc_id")))
