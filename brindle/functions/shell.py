"""Compound commands: segments between ``&&``, ``||``, ``;`` and ``|`` outside quotes and parentheses."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SEGMENTS = "array<struct<command:string,operator:string,redirects:array<string>>>"
_PIECE = re.compile(r"'[^']*(?:'|\Z)|\"(?:\\.|[^\"\\])*(?:\"|\Z)|(?P<bail>`|<<|\$[({])|(?P<open>\()|(?P<close>\))|(?P<op>&&|\|\||\||;)", re.S)
_REDIRECT = re.compile(r"^(?:\d?>&\d|&?>>?/dev/null|\d>>?/dev/null)$")


def split_compound(command: str | None) -> list[tuple[str, str | None, list[str]]] | None:
    """(command, operator behind it, redirects taken out) of each segment; null for a null command and for substitutions,
    here-documents and backticks outside quotes, which are not looked into."""
    if command is None:
        return None
    out, depth, at = [], 0, 0
    cuts: list[tuple[int, int, str | None]] = []
    for m in _PIECE.finditer(command):
        if m["bail"]:
            return None
        if m["open"]:
            depth += 1
        elif m["close"]:
            depth = max(0, depth - 1)
        elif m["op"] and depth == 0 and not (m["op"] == "&&" and command[m.start() - 1 : m.start()] == ">"):
            cuts.append((m.start(), m.end(), m["op"]))
    for a, b, op in [*cuts, (len(command), len(command), None)]:
        words, kept, gone, i = command[at:a].split(), [], [], 0
        while i < len(words):
            if words[i] == "2>" and words[i + 1 : i + 2] == ["/dev/null"]:
                gone += words[i : i + 2]
                i += 2
                continue
            (gone if _REDIRECT.match(words[i]) else kept).append(words[i])
            i += 1
        if words:
            out.append((" ".join(kept), op, gone))
        at = b
    return out


def split_column(command: Column) -> Column:
    @F.pandas_udf(SEGMENTS)
    def run(s: pd.Series) -> pd.Series:
        rows = (split_compound(c) for c in s)
        return pd.Series([None if r is None else [{"command": c, "operator": o, "redirects": g} for c, o, g in r] for r in rows], dtype=object)

    return run(command)
