"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import materialise, release


def _down(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger to its smaller end; loops go."""
    return edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """node, comp for every node of ``edges`` (columns a, b): comp is the smallest node it is connected with.

    A round points every node's larger neighbours, then its smaller ones, at the smallest it knows; about as many rounds
    as the logarithm of the longest path are needed. Minima are aggregated before the shuffle, so a node with very many
    neighbours is one row there. Each round is written to the shared folder, which cuts the lineage; ``release`` deletes
    the last one.
    """
    now = materialise(_down(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))), "edges")
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _down(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        new = materialise(_down(small), "edges")
        new_mark = _mark(new)
        release(now)
        now = new
        if new_mark == mark:
            break
        mark = new_mark
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    out = stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
    out._scratch_path = now._scratch_path
    return out


def _mark(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
