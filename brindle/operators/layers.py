"""Implementations of the seams in ``interfaces``: what a caller plugs in where these do not fit."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import lexical, savings, structural
from brindle.operators.interfaces import Invariant, apply_contract
from brindle.sources import history_text, sinks


@dataclass(frozen=True)
class LexicalLayer:
    """A search layer over a stored index."""

    index: lexical.Index
    config: lexical.Config = lexical.Config()

    def search(self, query: str, limit: int = 20, offset: int = 0) -> DataFrame:
        return lexical.ranked(self.index.search_text(query, self.config), limit, offset)


class LexicalBuilder:
    def build(self, files: DataFrame, path: str) -> LexicalLayer:
        return LexicalLayer(sinks.write_lexical_index(files, path))


@dataclass(frozen=True)
class StructuralLayer:
    """Structural search over n-gram postings, wherever they come from: ``postings`` gives the rows (doc_id, gp, p, c, count)."""

    postings: Callable[[], DataFrame]
    nodes: DataFrame
    langs: DataFrame

    def search(self, query: str, limit: int = 20, offset: int = 0) -> DataFrame:
        grams = self.postings()
        found = structural.search(grams, self.nodes, structural.idf(grams, self.langs), self.langs, query)
        return found.orderBy(F.desc("score"), "doc_id").offset(offset).limit(limit)


@dataclass(frozen=True)
class LogHistory:
    """A history source over exported logs (source, line_no, line)."""

    lines: DataFrame

    def commits(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        return history_text.parse_history_log(self.lines)


@dataclass(frozen=True)
class Transcripts:
    """A session provider over transcript lines, with the reader of their layout."""

    lines: DataFrame
    read: Callable[[DataFrame], DataFrame] = history_text.parse_sessions

    def sessions(self, spark: SparkSession) -> DataFrame:
        return self.read(self.lines)


@dataclass(frozen=True)
class SavingsStore:
    """The questions asked of savings records, over any table of them."""

    records: DataFrame

    def summary(self, since: int | None = None) -> DataFrame:
        return savings.summary(self.records, since)

    def daily(self) -> DataFrame:
        return savings.daily(self.records)

    def by_command(self) -> DataFrame:
        return savings.by_command(self.records)

    def by_language(self) -> DataFrame:
        return savings.by_language(self.records)

    def by_mode(self) -> DataFrame:
        return savings.by_mode(self.records)

    def top_commands(self) -> DataFrame:
        return savings.top_commands(self.records)

    def sessions(self) -> DataFrame:
        return savings.sessions(self.records)


@dataclass
class Invariants:
    """Named invariants of transforms; each takes input and output and says whether they hold."""

    known: dict[str, Invariant] = field(default_factory=dict)

    def register(self, name: str, check: Invariant) -> None:
        if name in self.known:
            raise ValueError(f"{name} is there already")
        self.known[name] = check

    def apply(self, df: DataFrame, col: str, transform: Callable[[Column], Column], *names: str) -> DataFrame:
        """``apply_contract`` under the named invariants, or under all."""
        return apply_contract(df, col, transform, [self.known[n] for n in names or self.known])
