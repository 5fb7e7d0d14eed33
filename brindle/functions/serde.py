"""Keys and nesting of JSON, YAML and TOML, and field maps: contiguous (start, end, field) byte ranges of a text."""

from __future__ import annotations

import re
import tomllib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions.json_tools import MAX_DEPTH, MAX_KEYS
from brindle.functions.json_tools import structure as json_structure

# Fields by their number.
FIELDS = ("type_definition", "function_signature", "symbol_name", "import_export", "function_body", "comment", "string_literal", "other")
SPANS = "array<struct<start:int,end:int,field:int>>"


def _keys(v, depth: int, count: list[int]) -> list[str]:
    """Indented ``key:`` lines; of an array its first element, if that is a table."""
    if depth > MAX_DEPTH:
        raise RecursionError
    if isinstance(v, list):
        return _keys(v[0], depth, count) if v and isinstance(v[0], dict) else []
    out = []
    if isinstance(v, dict):
        count[0] += len(v)
        if count[0] > MAX_KEYS:
            raise RecursionError
        for k, x in v.items():
            out.append("  " * depth + f"{k}" + (":" if isinstance(x, (dict, list)) else ""))
            out += _keys(x, depth + 1, count)
    return out


def yaml_structure(text: str) -> str:
    """Keys of each document, documents parted by ``---``; the text as it is where it does not parse or is too large."""
    import yaml

    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    try:
        return "\n---\n".join("\n".join(_keys(d, 0, [0])) for d in yaml.load_all(text, Loader=loader) if d is not None)
    except (yaml.YAMLError, RecursionError, ValueError, TypeError):
        return text


def toml_structure(text: str) -> str:
    try:
        return "\n".join(_keys(tomllib.loads(text), 0, [0]))
    except (tomllib.TOMLDecodeError, RecursionError):
        return text


STRUCTURES = {"json": json_structure, "yaml": yaml_structure, "toml": toml_structure}


def cover(spans: list[tuple[int, int, str]], n: int) -> list[tuple[int, int, str]]:
    """Sorted spans that do not overlap, with ``other`` between them and equal neighbours joined; nothing for no bytes."""
    out, at = [], 0
    for a, b, f in [*sorted(spans), (n, n, "other")]:
        for x, y, g in ((at, a, "other"), (max(a, at), b, f)):
            if y > x:
                if out and out[-1][2] == g:
                    out[-1] = (out[-1][0], y, g)
                else:
                    out.append((x, y, g))
        at = max(at, b)
    return out


_JSON = re.compile(r'"(?:\\.|[^"\\])*"|[{}\[\]:,]', re.S)


def json_fields(text: str) -> list[tuple[int, int, str]]:
    """Top-level keys of objects and arrays are type definitions, other keys symbols, string values literals."""
    out, depth, parts = [], 0, list(_JSON.finditer(text))
    for i, m in enumerate(parts):
        c = m.group()
        if c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
        elif c[0] == '"':
            key = i + 1 < len(parts) and parts[i + 1].group() == ":"
            opens = key and depth == 1 and i + 2 < len(parts) and parts[i + 2].group() in "{[" and not text[parts[i + 1].end() : parts[i + 2].start()].strip()
            out.append((m.start(), m.end(), "type_definition" if opens else "symbol_name" if key else "string_literal"))
    return out


def yaml_fields(text: str) -> list[tuple[int, int, str]]:
    """Line by line: keys (top-level ones that open a block are type definitions), quoted or plain values, comments."""
    out = []
    for m in re.finditer(r"[^\n]+", text):
        line, a = m.group(), m.start()
        if c := re.match(r"\s*(#.*)$", line):
            out.append((a + c.start(1), a + c.end(1), "comment"))
        elif k := re.match(r"([ \t]*)(?:- +)?((?:\"[^\"]*\"|'[^']*'|[^\s#&*?{\[\"'|>:-][^:#]*?)):(?=\s|$)[ \t]*(.*?)[ \t\r]*((?<!\S)#.*)?$", line):
            top = not k.group(1) and not k.group(3)
            out.append((a + k.start(2), a + k.end(2), "type_definition" if top else "symbol_name"))
            if k.group(3) and not re.match(r"[&*{\[|>]|-?\d|(?:true|false|null|~)$", k.group(3)):
                out.append((a + k.start(3), a + k.end(3), "string_literal"))
            if k.group(4):
                out.append((a + k.start(4), a + k.end(4), "comment"))
    return out


def toml_fields(text: str) -> list[tuple[int, int, str]]:
    """Section headers are type definitions, keys symbols, strings literals; comments outside strings."""
    out = []
    strings = r'"""(?:\\.|(?!""").)*"""|\'\'\'(?:(?!\'\'\').)*\'\'\'|"(?:\\.|[^"\\\n])*"|\'[^\'\n]*\''
    rx = re.compile(rf"(?P<head>^[ \t]*\[\[?[^\]\n]+\]\]?)|(?P<key>^[ \t]*[\w.\"'-]+(?=[ \t]*=))|(?P<text>{strings})|(?P<note>#[^\n]*)", re.S | re.M)
    names = {"head": "type_definition", "key": "symbol_name", "text": "string_literal", "note": "comment"}
    for m in rx.finditer(text):
        skip = len(m.group()) - len(m.group().lstrip())
        out.append((m.start() + skip, m.end(), names[m.lastgroup]))
    return out


def markdown_fields(text: str) -> list[tuple[int, int, str]]:
    """Headings of levels 1 to 3 are type definitions, code bodies, prose comments, link definitions imports."""
    out, fence = [], None
    for m in re.finditer(r"[^\n]+", text):
        line, a, b = m.group(), m.start(), m.end()
        mark = re.match(r" {0,3}(```+|~~~+)", line)
        if fence:
            out.append((a, b, "function_body"))
            fence = None if mark and mark.group(1).startswith(fence) else fence
        elif mark:
            fence = mark.group(1)
            out.append((a, b, "function_body"))
        elif h := re.match(r" {0,3}(#{1,6})(?:[ \t]|$)", line):
            out.append((a, b, "type_definition" if len(h.group(1)) <= 3 else "other"))
        elif re.match(r"    \S|\t\S", line):
            out.append((a, b, "function_body"))
        else:
            out.append((a, b, "import_export" if re.match(r" {0,3}\[[^\]]+\]:", line) else "comment"))
    return out


def code_fields(text: str, lang: str) -> list[tuple[int, int, str]]:
    """Comments and strings by the lexer; elsewhere the innermost block: bodies, heads of callables and types, imports."""
    from brindle.functions import source_modes as sm

    marks = ["other"] * len(text)

    def paint(a, b, f):
        marks[a:b] = [f] * (b - a)

    for m in re.finditer(r"(?m)^[ \t]*(?:(?:pub\s+)?use|import|from|#include|export\s*[{*]|using|require|package)\b[^\n]*", sm.masked(text, lang)):
        paint(m.start() + len(m.group()) - len(m.group().lstrip()), m.end(), "import_export")
    for a, opened, e, kind in sorted(sm.blocks(text, lang)) if lang in (*sm.BRACES, "python", "ruby") else ():
        if kind in ("callable", "type"):
            paint(a, opened, "function_signature" if kind == "callable" else "type_definition")
            paint(opened, e, "function_body" if kind == "callable" else "type_definition")
    for a, b, kind in sm.tokens(text, lang):
        paint(a, b, "comment" if kind == "comment" else "string_literal")
    out, at = [], 0
    for i in range(1, len(text) + 1):
        if i == len(text) or marks[i] != marks[at]:
            out.append((at, i, marks[at]))
            at = i
    return out


def field_map(text: str | None, lang: str | None) -> list[tuple[int, int, str]]:
    """Ranges in UTF-8 bytes that cover the whole text; all ``other`` for an unknown language, none for an empty text."""
    if not text:
        return []
    by = {"json": json_fields, "yaml": yaml_fields, "toml": toml_fields, "markdown": markdown_fields}
    spans = [] if lang is None else by[lang](text) if lang in by else code_fields(text, lang)
    full = cover(spans, len(text))
    if text.isascii():
        return full
    at, k, to_byte = 0, 0, {}
    for i in sorted({x for a, b, _ in full for x in (a, b)}):
        at += len(text[k:i].encode("utf-8", "surrogatepass"))
        to_byte[i], k = at, i
    return [(to_byte[a], to_byte[b], f) for a, b, f in full]


def field_map_column(text: Column, lang: Column) -> Column:
    @F.pandas_udf(SPANS)
    def run(t: pd.Series, l: pd.Series) -> pd.Series:  # noqa: E741
        return pd.Series([[{"start": a, "end": b, "field": FIELDS.index(f)} for a, b, f in field_map(x, y)] for x, y in zip(t, l, strict=True)], dtype=object)

    return run(text, lang)


def encode_field_map(ranges: Column) -> Column:
    """A field map (array of start, end, field) as a JSON array of triples."""
    return F.to_json(F.transform(ranges, lambda r: F.array(r["start"].cast("int"), r["end"].cast("int"), r["field"].cast("int"))))


def decode_field_map(text: Column) -> Column:
    """The field map of such a text; null where a triple is not whole or a range ends before it begins."""
    rows = F.from_json(text, "array<array<int>>")
    good = F.forall(rows, lambda r: F.coalesce((F.size(r) == 3) & (r[0] <= r[1]) & r[2].isNotNull(), F.lit(False)))
    return F.when(good, F.transform(rows, lambda r: F.struct(r[0].alias("start"), r[1].alias("end"), r[2].alias("field"))))
