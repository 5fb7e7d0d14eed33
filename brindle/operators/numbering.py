"""Global positions of rows without a sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one range, about, the most ranges, and sampled keys for each of them.
ROWS, MOST_RANGES, SAMPLED = 100_000, 512, 64


def number_rows(df: DataFrame, keys: list[Column], name: str, rows: int = ROWS) -> DataFrame:
    """``df`` with ``name``: each row's position, from 0, in ascending order of ``keys`` (nulls first).

    Rows are dealt to ranges whose bounds come from a sample of keys (at most SAMPLED * MOST_RANGES rows on the driver); a row's
    position is its place in its range plus the rows of the ranges before. Bounds change how even the ranges are, never
    a position. Equal keys have positions in no set order, so end ``keys`` with one that is unique.
    """
    keyed = df.withColumn("_key", F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys))))
    n = keyed.count()
    ranges = min(MOST_RANGES, -(-n // rows))
    if ranges <= 1:
        placed = keyed.withColumn("_range", F.lit(0)).withColumn("_before", F.lit(0).cast("bigint"))  # at most ``rows`` rows
    else:
        share = min(1.0, SAMPLED * ranges / n)
        sample = keyed.select("_key").filter(F.pmod(F.xxhash64("_key"), F.lit(1 << 20)) < share * (1 << 20))
        bounds = sample.groupBy().agg(F.sort_array(F.collect_list("_key")).alias("s")).select(
            F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), lambda i: F.get("s", F.floor(i * F.size("s") / ranges).cast("int"))).alias("bounds")
        )
        wide = keyed.join(F.broadcast(bounds.withColumn("_one", F.lit(1))), F.lit(1) == F.col("_one")).withColumn("_range", F.size(F.filter("bounds", lambda b: b <= F.col("_key")))).drop("bounds", "_one")
        sizes = {r["_range"]: r["count"] for r in wide.groupBy("_range").count().collect()}
        before, at = [], 0
        for i in range(ranges):
            before.append(at)
            at += sizes.get(i, 0)
        placed = wide.withColumn("_before", F.get(F.array(*(F.lit(b).cast("bigint") for b in before)), F.col("_range")))
    within = F.row_number().over(Window.partitionBy("_range").orderBy("_key"))
    return placed.withColumn(name, (F.col("_before") + within - 1).cast("bigint")).drop("_key", "_range", "_before")
