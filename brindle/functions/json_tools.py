"""JSON reduction that keeps every number and escape as it is written; run in Arrow batches."""

from __future__ import annotations

import json
import re
from decimal import Decimal
from itertools import accumulate

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from brindle.functions.text import strict_json

MAX_DEPTH, MAX_KEYS = 500, 10_000


_STRING = r'"(?:[^"\\]|\\.)*"'
_TOKEN = re.compile(_STRING + r"|[ \t\r\n]+", re.S)
_WORDS = re.compile(_STRING, re.S)


def minify(text: str | None) -> str | None:
    """The text without blanks outside strings; as it is where it is not strict JSON, too deep or wide, or not shortened."""
    if text is None or not strict_json(text):
        return text
    new = _TOKEN.sub(lambda m: m[0] if m[0][0] == '"' else "", text)
    marks = _WORDS.sub("", new)
    depth = list(accumulate(1 if c in "{[" else -1 for c in marks if c in "{[]}"))
    return text if max(depth) > MAX_DEPTH or marks.count(":") > MAX_KEYS or len(new) >= len(text) else new


def structure(text: str | None) -> str | None:
    """Keys and nesting without values: of an array, its first element if that is an object; a scalar root gives nothing."""
    if text is None:
        return None
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return text
    count = 0

    def walk(v, depth):
        nonlocal count
        if depth > MAX_DEPTH:
            raise RecursionError
        if isinstance(v, dict):
            count += len(v)
            if count > MAX_KEYS:
                raise RecursionError
            return {k: walk(x, depth + 1) for k, x in v.items()}
        if isinstance(v, list):
            return [walk(v[0], depth + 1)] if v and isinstance(v[0], dict) else []
        return None

    def show(v, indent):
        if isinstance(v, dict):
            return "{\n" + ",\n".join(f"{'  ' * (indent + 1)}{k}" + (f": {show(x, indent + 1)}" if x is not None else "") for k, x in v.items()) + f"\n{'  ' * indent}}}" if v else "{}"
        return f"[{show(v[0], indent)}]" if v else "[]"

    try:
        shape = walk(value, 0)
    except RecursionError:
        return text
    return "" if shape is None else show(shape, 0)


def equal(a: str | None, b: str | None) -> bool | None:
    """Whether two documents mean the same: objects without order, arrays with it, numbers by value; null if either is."""
    if a is None or b is None:
        return None
    try:
        return _canonical(json.loads(a, parse_float=Decimal, parse_int=Decimal), 0) == _canonical(json.loads(b, parse_float=Decimal, parse_int=Decimal), 0)
    except (ValueError, RecursionError):
        return False


class _Number(str):
    """A number as it is written."""


def equal_raw(a: str | None, b: str | None, work: int = 100_000) -> bool | None:
    """As ``equal``, but numbers are the same only if they are written alike, and more than ``work`` values (or repeated keys) are
    taken as different; null if either is."""
    if a is None or b is None:
        return None
    left = work

    def once(pairs):
        nonlocal left
        left -= len(pairs) + 1
        if left < 0 or len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("too much, or a repeated key")
        return dict(pairs)

    try:
        x, y = (json.loads(t, object_pairs_hook=once, parse_float=_Number, parse_int=_Number, parse_constant=_Number) for t in (a, b))
        return _canonical(x, 0) == _canonical(y, 0)
    except (ValueError, RecursionError):
        return False


def _canonical(v, depth):
    if depth > 64:
        raise RecursionError
    if isinstance(v, dict):
        return ("o", tuple(sorted((k, _canonical(x, depth + 1)) for k, x in v.items())))
    if isinstance(v, list):
        return ("a", tuple(_canonical(x, depth + 1) for x in v))
    return (type(v).__name__, v)


@F.pandas_udf(StringType())
def minify_column(s: pd.Series) -> pd.Series:
    return s.map(minify)


@F.pandas_udf(StringType())
def structure_column(s: pd.Series) -> pd.Series:
    return s.map(structure)


@F.pandas_udf(BooleanType())
def equal_columns(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([equal(x, y) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(BooleanType())
def equal_raw_columns(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([equal_raw(x, y) for x, y in zip(a, b, strict=True)])
