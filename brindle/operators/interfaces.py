"""What can be plugged in: each seam takes and gives DataFrames or Columns, so that any implementation stays in the plan."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.text import byte_gate


@runtime_checkable
class SearchLayer(Protocol):
    def search(self, query: str, limit: int = 20, offset: int = 0) -> DataFrame:
        """doc_id, score of the best documents."""


@runtime_checkable
class LayerBuilder(Protocol):
    def build(self, files: DataFrame, path: str) -> SearchLayer:
        """Index files below ``path``."""


@runtime_checkable
class HistorySource(Protocol):
    def commits(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """(commits, touches)."""


@runtime_checkable
class SessionProvider(Protocol):
    def sessions(self, spark: SparkSession) -> DataFrame:
        """Tool invocations."""


FieldClassifier = Callable[[Column, Column], Column]
TokenCounter = Callable[[Column], Column]
Invariant = Callable[[Column, Column], Column]


def apply_contract(df: DataFrame, col: str, transform: Callable[[Column], Column], invariants: Iterable[Invariant] = ()) -> DataFrame:
    """``df`` with ``out`` and ``accepted``: the transformed column where it is not longer in bytes and every invariant (of input and
    output) holds, else the input. A null input is accepted as null."""
    rows = df.withColumn("__new", transform(F.col(col)))
    before, after = F.col(col), F.col("__new")
    holds = F.octet_length(after) <= F.octet_length(before)
    for check in invariants:
        holds = holds & check(before, after)
    ok = F.when(before.isNull(), after.isNull()).otherwise(F.coalesce(holds, F.lit(False)))
    return rows.withColumn("out", F.when(ok, byte_gate(before, after)).otherwise(before)).withColumn("accepted", ok).drop("__new")
