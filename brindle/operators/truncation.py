"""Fitting texts into budgets: by tokens, by line priority, by cascading modes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import lines_of

MARKER = "... (truncated)"
# The order of modes from the fullest to the shortest.
MODES = ("full", "minimal", "pseudo", "structure", "signatures", "types")


def to_token_budget(text: Column, budget: int, bytes_per_token: int = 4) -> Column:
    """The longest run of first lines whose tokens (bytes over ``bytes_per_token``, rounded up a line) and the marker's fit."""
    cost = lambda c: F.ceil((F.octet_length(c) + 1) / bytes_per_token).cast("bigint")
    lines = lines_of(text)
    total = F.aggregate(lines, F.lit(0).cast("bigint"), lambda a, x: a + cost(x))
    room = budget - -(-(len(MARKER) + 1) // bytes_per_token)
    state = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).alias("n"), F.lit(True).alias("open"))
    fit = F.aggregate(lines, state, lambda s, x: F.struct((s["sum"] + cost(x)).alias("sum"), (s["n"] + F.when(s["open"] & (s["sum"] + cost(x) <= room), 1).otherwise(0)).alias("n"), (s["open"] & (s["sum"] + cost(x) <= room)).alias("open")))
    return F.when(total <= budget, text).otherwise(F.array_join(F.concat(F.slice(lines, F.lit(1), fit["n"]), F.array(F.lit(MARKER))), "\n"))


def cascade(outputs: DataFrame, budget: int, modes=MODES, tokens: str = "tokens") -> DataFrame:
    """doc_id, mode, text: the first mode (rows doc_id, mode, text, tokens) that fits, else the last one there is."""
    order = F.array_position(F.array(*map(F.lit, modes)), F.col("mode"))
    rank = F.struct((F.col(tokens) > budget).alias("over"), F.when(F.col(tokens) > budget, -order).otherwise(order).alias("order"))
    return outputs.groupBy("doc_id").agg(F.min_by(F.struct("mode", "text"), rank).alias("best")).select("doc_id", "best.mode", "best.text")


def by_priority(lines: list[str], spans: list[tuple[int, int, int]], most: int) -> list[str]:
    """``most`` lines at most: spans (start, end, priority) in descending priority, then order, with a marker for each gap.

    Spans are dropped from the lowest priority up until content and markers fit.
    """
    if len(lines) <= most:
        return lines
    kept = sorted(spans, key=lambda s: (-s[2], s[0]))
    while True:
        chosen = sorted({i for a, b, _ in kept for i in range(a, min(b, len(lines)))})
        out, at = [], 0
        for i in chosen:
            if i > at:
                out.append(f"... ({i - at} lines omitted)")
            out.append(lines[i])
            at = i + 1
        if at < len(lines):
            out.append(f"... ({len(lines) - at} lines omitted)")
        if len(out) <= most or not kept:
            return out[:most]
        kept.pop()


def truncate_by_priority(docs: DataFrame, most: int) -> DataFrame:
    """doc_id, text of docs (doc_id, text, spans: array of start, end, priority), in pandas batches."""

    def run(batches):
        for pdf in batches:
            rows = [(d, "\n".join(by_priority((t or "").split("\n"), [(s["start"], s["end"], s["priority"]) for s in (sp if sp is not None else [])], most))) for d, t, sp in zip(pdf.doc_id, pdf.text, pdf.spans, strict=True)]
            yield pd.DataFrame(rows, columns=["doc_id", "text"])

    return docs.select("doc_id", "text", "spans").mapInPandas(run, "doc_id bigint, text string")
