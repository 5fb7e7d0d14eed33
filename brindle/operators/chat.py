"""Reduction of chat request bodies: find the provider, take text blocks apart, route each to an engine, keep what is shorter."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from brindle.functions import text as tx
from brindle.functions.json_tools import equal_raw, minify

# Beginnings of model names that mark one of the two body layouts.
OPENAI_MODELS = "^(gpt-|o1-|o3-|o4-|text-davinci|davinci)"
BLOCK_TYPES = r'"type"\s*:\s*"(tool_use|tool_result|thinking)"'
_FENCE = re.compile(r"(?ms)^([ \t]*```[ \t]*json[ \t]*\r?\n)(.*?)(^[ \t]*```)")
_STAMP = re.compile(r"^\[?\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?\]?\s*")


def provider(body: Column) -> Column:
    """openai or anthropic, by response_format, tool calls, the developer role, block types, max_tokens, then the model's name;
    null for what is no object with a messages array."""
    part = lambda p: F.get_json_object(body, p)
    messages = F.from_json(body, "struct<messages:array<struct<role:string,content:string,tool_calls:string,tool_call_id:string>>>")["messages"]
    openai = F.exists(messages, lambda m: m["tool_calls"].isNotNull() | m["tool_call_id"].isNotNull() | (m["role"] == "developer"))
    blocks = F.exists(messages, lambda m: m["content"].startswith("[") & m["content"].rlike(BLOCK_TYPES))
    yes = lambda c: F.coalesce(c, F.lit(False))
    kind = F.when(part("$.response_format").isNotNull() | yes(openai), "openai").when(yes(blocks) | part("$.max_tokens").isNotNull(), "anthropic").when(yes(part("$.model").rlike(OPENAI_MODELS)), "openai").otherwise("anthropic")
    return F.when(messages.isNotNull(), kind)


def text_blocks(bodies: DataFrame) -> DataFrame:
    """request_id, message_no, block_no, role, text of bodies (request_id, body): string contents, text blocks and tool results."""
    msgs = F.from_json("body", "struct<messages:array<struct<role:string,content:string>>>")["messages"]
    rows = bodies.select("request_id", F.posexplode(msgs).alias("message_no", "m")).select("request_id", "message_no", "m.role", "m.content")
    parts = F.from_json("content", "array<struct<type:string,text:string,content:string>>")
    told = F.transform(F.filter(parts, lambda p: p["type"].isin("text", "tool_result")), lambda p: F.coalesce(p["text"], p["content"]))
    is_list = F.col("content").rlike(r'^\s*\[\s*\{\s*"') & parts.isNotNull() & (F.size(F.filter(parts, lambda p: p["type"].isNotNull())) > 0)
    return rows.select("request_id", "message_no", "role", F.posexplode(F.when(is_list, told).otherwise(F.array("content"))).alias("block_no", "text")).filter("text IS NOT NULL")


def reduce_mixed(text: str) -> str:
    """``json`` fences without blanks where that means the same value for value; every other byte as it is."""
    def one(m: re.Match) -> str:
        body = m[2].rstrip("\r\n")
        new = minify(body)
        return m[1] + (new if new != body and equal_raw(body, new) else body) + m[2][len(body) :] + m[3]

    return _FENCE.sub(one, text)


def reduce_log(text: str) -> str:
    """Runs of lines that differ in their stamps only are given once, with their number and the last stamp.

    Lines stay in their order, and lines of different levels or words never join, so nothing but repeated words goes.
    """
    out: list[list] = []  # words, first line, number, last stamp
    for line in text.split("\n"):
        stamp = m[0].strip() if (m := _STAMP.match(line)) else ""
        words = line[m.end() :] if m else line
        if out and out[-1][0] == words and words.strip() and bool(stamp) == bool(out[-1][3]):
            out[-1][2:] = [out[-1][2] + 1, stamp]
        else:
            out.append([words, line, 1, stamp])
    return "\n".join(line if n == 1 else f"{line} (x{n}{f', last {stamp}' if stamp else ''})" for _, line, n, stamp in out)


def route(blocks: DataFrame) -> DataFrame:
    """Blocks with content_class, engine, outcome (compressed or passthrough), reason, bytes_in, bytes_out and text_out.

    Only blocks an engine looks at go through Python. A block never grows: what is not shorter stays as it is.
    """

    @F.pandas_udf(StringType())
    def run(text: pd.Series, kind: pd.Series) -> pd.Series:
        by = {"json": minify, "mixed": reduce_mixed, "log": reduce_log}
        return pd.Series([by[k](t) if k in by and t is not None else None for t, k in zip(text, kind, strict=True)], dtype=object)

    rows = tx.classify(blocks, "text")
    engine, look = tx.engine(F.col("content_class")), tx.prefilter(F.col("text"), F.col("content_class"))
    rows = rows.withColumn("engine", engine).withColumn("looked_at", F.coalesce(look, F.lit(False)))
    rows = rows.withColumn("candidate", run(F.when(F.col("looked_at"), F.col("text")), F.when(F.col("looked_at"), F.col("engine"))))
    shorter = F.coalesce(F.octet_length("candidate") < F.octet_length("text"), F.lit(False))
    reason = F.when(F.col("engine") == "passthrough", "no_engine").when(~F.col("looked_at"), "prefilter").when(~shorter, "not_smaller")
    out = F.when(shorter, F.col("candidate")).otherwise(F.col("text"))
    return rows.withColumn("outcome", F.when(shorter, "compressed").otherwise("passthrough")).withColumn("reason", reason).withColumn("bytes_in", F.octet_length("text")).withColumn("bytes_out", F.octet_length(out)).withColumn("text_out", out).drop("candidate", "looked_at")
