"""Mixing sources to target weights: Efraimidis-Spirakis sampling under word budgets.

Every document gets an exponential key, ``-ln(u) / quality``. A source's whole epochs are taken first; of the last,
fractional epoch the documents with the smallest keys, by a prefix sum of their sizes up to the budget. Keys are hashes
of the document, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import WORD, materialise

#: A (source, key range) bucket holds about this many documents at most: the largest sort of one task.
BUCKET_ROWS = 10_000
LEAST_BUCKETS = 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"({WORD})")), F.lit(0)).cast("bigint")


def quality(text: Column, words: Column) -> Column:
    """A weight from 0.05 to 1: the share of lines that are distinct, halved where words are unusually short or long."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    mean = F.length(text) / F.greatest(words, F.lit(1))
    shape = F.when(mean.between(3, 15), 1.0).otherwise(0.5)
    return F.greatest(F.lit(0.05), F.size(F.array_distinct(lines)) / F.size(lines) * shape)


def source_key(source: Column) -> Column:
    """Never null; sorts by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def targets(sizes: DataFrame, weights=(5, 2, 1), cap: float = 3.0) -> DataFrame:
    """skey, source_size, n, target, capped of each source; ``sizes`` has skey, source_size, n, one row a source.

    All sizes are shared out by weight; a share above ``cap`` times its source stops there and the excess is shared again
    by weight. The end of that process is found at once: in ascending order of cap / weight the first source whose level
    (what is left over the weights that are left) reaches no cap sets the level of all that follow. The windows have
    no partition: they sort one row a source, not documents, so one task holds as many rows as there are sources (a million
    sources are some 100 MB there).
    """
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.row_number().over(Window.orderBy("skey")) - 1) % len(weights) + 1)
    limit = F.lit(float(cap)) * F.col("source_size")
    by_ratio = Window.orderBy("ratio", "skey")
    every = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    out = sizes.withColumn("weight", weight).withColumn("limit", limit).withColumn("ratio", F.col("limit") / F.col("weight"))
    out = out.withColumn("level", left / F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    final = F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(every)
    out = out.withColumn("share", F.coalesce(final, F.lit(float("inf"))) * F.col("weight"))
    capped = F.col("share") >= F.col("limit")
    return out.select("skey", "source_size", "n", F.when(capped, F.col("limit")).otherwise(F.col("share")).alias("target"), capped.alias("capped"))


def sample(docs: DataFrame, weights=(5, 2, 1), cap: int = 3, seed: int = 17, carry: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, epochs, taken of every document; with ``carry`` also row, all of its columns.

    ``docs`` has doc_id, source and text. size is the number of words, 0 for null and empty texts, which are never taken.
    taken counts words: size for each whole epoch, and in the fractional one size for the documents within the
    budget; the one document on which the budget ends gives its first words only, so a source meets its target to a word.
    Repeated rows are documents of their own. Columns of any other name may be there.

    The prefix sum has two levels, so that no source is sorted in one task: word sums of key ranges of each source, then a
    running sum within a range. Ranges are equally wide in the logarithm of the key. There the density of an exponential
    key is at most 1/e whatever its quality, so no mixture of qualities fills a range with more than its width / e of a
    source; the width follows from the largest source.
    """
    text = F.col("text")
    named = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text)
    uniform = (F.conv(F.substring(F.md5(named), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    row = [F.struct(*docs.columns).alias("row")] if carry else []
    keyed = docs.select("doc_id", "source", "text", *row).withColumn("size", word_count(text))
    keyed = keyed.select("doc_id", source_key(F.col("source")).alias("skey"), (-F.log(uniform) / quality(text, F.col("size"))).alias("key"), "size", *(["row"] if carry else []))
    narrow = materialise(keyed.select("doc_id", "skey", "key", "size"), "mix")

    sizes = narrow.groupBy("skey").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    steps = max(LEAST_BUCKETS, math.ceil(most / math.e / BUCKET_ROWS))  # ranges to a factor of e
    bucket = lambda key: F.floor(F.log(key) * steps).cast("bigint")

    plan = targets(sizes, weights, cap)
    epochs = F.when(F.col("source_size") == 0, 0).when(F.col("capped"), cap).otherwise(F.floor(F.col("target") / F.col("source_size"))).cast("bigint")
    plan = plan.withColumn("epochs", epochs).withColumn("budget", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("bigint"))
    ranges = narrow.groupBy("skey", bucket(F.col("key")).alias("bucket")).agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("skey").orderBy("bucket")) - F.col("words")
    ranges = ranges.withColumn("before", before).join(plan, "skey").select("skey", "bucket", "before", "source_size", "target", "epochs", "budget")

    rows = (keyed if carry else narrow).withColumn("bucket", bucket(F.col("key"))).join(ranges, ["skey", "bucket"])
    within = Window.partitionBy("skey", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("before") + F.sum("size").over(within) - F.col("size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - start))
    rows = rows.withColumn("taken", (F.col("epochs") * F.col("size") + part).cast("bigint"))
    return rows.select("doc_id", "size", "source_size", "target", "epochs", "taken", *(["row"] if carry else []))


def apply(docs: DataFrame, weights=(5, 2, 1), cap: int = 3, seed: int = 17) -> DataFrame:
    """The mixed corpus: rows of ``docs``, unchanged, each as often as it is taken.

    The document on which a source's budget ends is kept whole if at least half of its words are within the budget, else left
    out, so a source misses its target by half of that document at most. Documents without words are never taken.
    """
    rows = sample(docs, weights, cap, seed, carry=True).filter("taken > 0")
    copies = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    return rows.filter(copies > 0).select("row", F.explode(F.sequence(F.lit(1), copies)).alias("copy")).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
