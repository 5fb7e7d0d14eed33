"""Structural search over syntax nodes: doc_id, ord (pre-order), kind, depth. N-grams are parent-child paths."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_DEPTH, MAX_NODES = 500, 100_000

# Named patterns as (bigrams, trigrams) of node kinds, parent first.
PATTERNS = {
    "try-catch": ([("try_statement", "catch_clause")], []),
    "try-finally": ([("try_statement", "finally_clause")], []),
    "python-try-except": ([("try_statement", "except_clause")], []),
    "ruby-begin-rescue": ([("body_statement", "rescue")], []),
    "empty-catch": ([("__empty_body__", "catch_clause")], []),
    "try-catch-finally": ([("try_statement", "catch_clause"), ("try_statement", "finally_clause")], []),
    "nested-loop": ([], [("for_statement", "statement_block", "for_statement")]),
    "rust-nested-loop": ([], [("block", "expression_statement", "for_expression")]),
    "call-in-loop": ([], [("for_in_statement", "statement_block", "expression_statement")]),
    "deep-nesting": ([("__deep_node__", "__deep_node_b4__")], []),
    "python-nested-loop": ([], [("for_statement", "block", "for_statement")]),
    "go-goroutine": ([("go_statement", "call_expression")], []),
    "go-defer": ([("defer_statement", "call_expression")], []),
    "go-channel-send": ([("send_statement", "identifier")], []),
    "go-select": ([("select_statement", "communication_case")], []),
    "rust-unsafe-block": ([("unsafe_block", "block")], []),
    "java-synchronized": ([("synchronized_statement", "block")], []),
    "function-with-body": ([("function_item", "block")], []),
    "method-with-body": ([("method_definition", "statement_block")], []),
    "match-with-arms": ([("match_expression", "match_block")], [("match_expression", "match_block", "match_arm")]),
    "empty-function": ([("__empty_body__", "function_item")], []),
    "god-function": ([("__large_body__", "__large_body_b20__")], []),
    "excessive-params": ([("__many_params__", "__many_params_b5__")], []),
    "unhandled-result": ([("expression_statement", "call_expression")], []),
    "switch-with-cases": ([("switch_statement", "switch_body")], []),
    "impl-method": ([("impl_item", "declaration_list")], [("impl_item", "declaration_list", "function_item")]),
    "class-method": ([("class_declaration", "class_body")], [("class_declaration", "class_body", "method_definition")]),
    "ternary-expression": ([("variable_declarator", "ternary_expression")], []),
    "numeric-literal-in-expression": ([("binary_expression", "number")], []),
}


def parse_query(text: str) -> tuple[list[tuple[str, ...]], list[tuple[str, ...]]]:
    """(bigrams, trigrams) of a pattern name, or of ``A > B`` or ``A > B > C``; anything else raises ValueError."""
    text = text.strip()
    if not text or len(text.encode()) > 4096 or ">>" in text:
        raise ValueError("bad structural query")
    parts = tuple(p.strip() for p in text.split(">"))
    if len(parts) == 1:
        if "-" in text:
            if text not in PATTERNS:
                raise ValueError(f"unknown pattern {text}")
            return PATTERNS[text]
        return [(text,)], []
    if not all(parts) or len(parts) > 3:
        raise ValueError("bad structural query")
    return ([parts], []) if len(parts) == 2 else ([], [parts])


def python_nodes(source: str) -> list[tuple[int, str, int]]:
    """(ord, kind, depth) of Python source by its own parser; nothing for a text that does not parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out, stack = [], [(tree, 0)]
    while stack and len(out) < MAX_NODES:
        node, depth = stack.pop()
        out.append((len(out), type(node).__name__, depth))
        if depth < MAX_DEPTH:
            stack += [(c, depth + 1) for c in reversed(list(ast.iter_child_nodes(node)))]
    return out


def node_table(files: DataFrame) -> DataFrame:
    """doc_id, ord, kind, depth of Python files (doc_id, content), in pandas batches."""
    def run(batches):
        for pdf in batches:
            rows = [(d, *n) for d, c in zip(pdf.doc_id, pdf.content, strict=True) for n in python_nodes(c or "")]
            yield pd.DataFrame(rows, columns=["doc_id", "ord", "kind", "depth"])

    return files.select("doc_id", "content").mapInPandas(run, "doc_id bigint, ord int, kind string, depth int")


def ngrams(nodes: DataFrame) -> DataFrame:
    """doc_id, gp, p, c, count: parent-child pairs (gp null) and triples.

    The parent is the last earlier node one level up. Nodes are shuffled once by document and read as a sorted stream with
    the path to the current node as its only state; counting is a native aggregation in the same partitions.
    """

    def fold(batches):
        doc, path = None, []
        for pdf in batches:
            rows = []
            for d, kind, depth in zip(pdf.doc_id.tolist(), pdf.kind.tolist(), pdf.depth.tolist(), strict=True):
                if d != doc:
                    doc, path = d, []
                del path[depth:]
                path += [None] * (depth - len(path))
                if depth >= 1 and path[-1] is not None:
                    rows.append((d, None, path[-1], kind))
                    if depth >= 2 and path[-2] is not None:
                        rows.append((d, path[-2], path[-1], kind))
                path.append(kind)
            yield pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype="int64" if i == 0 else "object") for i, n in enumerate(("doc_id", "gp", "p", "c"))})

    stream = nodes.select("doc_id", "ord", "kind", "depth").repartition("doc_id").sortWithinPartitions("doc_id", "ord")
    return stream.mapInPandas(fold, "doc_id bigint, gp string, p string, c string").groupBy("doc_id", "gp", "p", "c").agg(F.count("*").alias("count"))


# Node kinds that markers and metrics look at.
BODIES = frozenset(("statement_block", "block", "compound_statement", "constructor_body", "body_statement", "function_body"))
PARAMETERS = frozenset(("formal_parameters", "parameters", "formal_parameter_list", "parameter_list", "method_parameters"))
CALLABLES = frozenset((
    "function_item", "function_definition", "method_definition", "arrow_function", "function_expression", "template_declaration", "constructor_declaration", "method", "singleton_method", "init_declaration",
    "deinit_declaration", "secondary_constructor", "anonymous_initializer",
))
BRANCHES = frozenset((
    "if_statement", "if_expression", "conditional_expression", "ternary_expression", "while_statement", "while_expression", "for_statement", "for_in_statement", "for_expression", "loop_expression", "do_statement",
    "match_expression", "switch_statement", "switch_expression", "case_statement", "try_statement", "catch_clause", "except_clause", "rescue_clause",
))
MARKER_COLUMNS = ("doc_id", "p", "c", "max_depth", "max_block_stmts", "max_params", "branch_count")
# Bucket edges of the synthetic markers.
EDGES = {"__large_body__": ((10, "b10"), (20, "b20"), (40, "b40")), "__many_params__": ((5, "b5"), (8, "b8"), (12, "b12")), "__deep_node__": ((4, "b4"), (6, "b6"), (8, "b8"))}


def _crossed(marker: str, value: int) -> list[tuple[str, str]]:
    return [(marker, f"{marker[:-2]}_{name}__") for edge, name in EDGES[marker] if value >= edge]


def markers(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(grams, metrics): synthetic pairs as in ``ngrams`` and, per document, max_depth, max_block_stmts, max_params, branch_count.

    A body without children gives (__empty_body__, what holds it); bodies of callables, parameter lists and depths give a pair for
    every bucket edge they reach. Punctuation, operators and comments are no children. One sorted stream, as in ``ngrams``.
    """

    def fold(batches):
        doc, path, rows, best = None, [], [], None

        def close(depth):
            while len(path) > depth:
                kind, n = path.pop()
                held = path[-1][0] if path else None
                if kind in BODIES and held is not None:
                    if n == 0:
                        rows.append((doc, "__empty_body__", held, None, None, None, None))
                    if held in CALLABLES:
                        best[1] = max(best[1], n)
                        rows.extend((doc, *g, None, None, None, None) for g in _crossed("__large_body__", n))
                if kind in PARAMETERS:
                    best[2] = max(best[2], n)
                    rows.extend((doc, *g, None, None, None, None) for g in _crossed("__many_params__", n))

        def frame():
            out = pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype="int64" if i == 0 else "object" if i < 3 else "Int32") for i, n in enumerate(MARKER_COLUMNS)})
            rows.clear()
            return out

        for pdf in batches:
            for d, kind, depth in zip(pdf.doc_id.tolist(), pdf.kind.tolist(), pdf.depth.tolist(), strict=True):
                if d != doc:
                    if doc is not None:
                        close(0)
                        rows.append((doc, None, None, *best))
                    doc, best = d, [0, 0, 0, 0]
                close(depth)
                path.extend([None, 0] for _ in range(depth - len(path)))
                if depth and re.search(r"\w", kind) and "comment" not in kind:
                    path[-1][1] += 1
                best[0] = max(best[0], depth)
                best[3] += kind in BRANCHES
                rows.extend((d, *g, None, None, None, None) for g in _crossed("__deep_node__", depth))
                path.append([kind, 0])
            yield frame()
        if doc is not None:
            close(0)
            rows.append((doc, None, None, *best))
            yield frame()

    stream = nodes.select("doc_id", "ord", "kind", "depth").repartition("doc_id").sortWithinPartitions("doc_id", "ord")
    out = stream.mapInPandas(fold, "doc_id bigint, p string, c string, max_depth int, max_block_stmts int, max_params int, branch_count int")
    grams = out.filter("p IS NOT NULL").groupBy("doc_id", F.lit(None).cast("string").alias("gp"), "p", "c").agg(F.count("*").alias("count"))
    return grams, out.filter("p IS NULL").select("doc_id", *MARKER_COLUMNS[3:])


def idf(grams: DataFrame, langs: DataFrame) -> DataFrame:
    """lang, gp, p, c, idf: per language, ln(n / (df + 1)) in single precision, plus 1."""
    n = langs.groupBy("lang").agg(F.count("*").alias("n"))
    df = grams.join(langs, "doc_id").groupBy("lang", "gp", "p", "c").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n), "lang").select("lang", "gp", "p", "c", (F.log(F.col("n") / (F.col("df") + 1)).cast("float") + F.lit(1.0).cast("float")).cast("double").alias("idf"))


def search(grams: DataFrame, nodes: DataFrame, weights: DataFrame, langs: DataFrame, query: str, lang: str | None = None) -> DataFrame:
    """doc_id, score: the sum of idf * t / (t + 1.2) over the query's distinct n-grams, t = count / length norm."""
    bi, tri = parse_query(query)
    wanted = F.lit(False)
    for g in {*bi, *tri}:
        gp, p, c = ((None, *g) if len(g) == 2 else g) if len(g) > 1 else (None, None, g[0])
        hit = F.col("c") == c
        hit = hit & (F.col("p") == p) if p else hit
        wanted = wanted | (hit & (F.col("gp") == gp if gp else F.col("gp").isNull()))
    size = nodes.groupBy("doc_id").agg(F.count("*").alias("nodes"))
    mean = size.agg(F.avg("nodes").alias("avg")).withColumn("k", F.lit(1))
    rows = grams.filter(wanted).join(langs if lang is None else langs.filter(F.col("lang") == lang), "doc_id").join(size, "doc_id").withColumn("k", F.lit(1)).join(F.broadcast(mean), "k")
    on = (rows["lang"] == weights["lang"]) & rows["gp"].eqNullSafe(weights["gp"]) & (rows["p"] == weights["p"]) & (rows["c"] == weights["c"])
    rows = rows.join(weights, on, "left").select(rows["doc_id"], "count", "nodes", "avg", F.coalesce("idf", F.lit(1.0)).alias("idf"))
    norm = F.when(F.col("avg") > 0, 0.25 + 0.75 * F.col("nodes") / F.col("avg")).otherwise(1.0)
    t = F.col("count") / norm
    return rows.groupBy("doc_id").agg(F.round(F.sum(F.col("idf") * t / (t + 1.2)), 6).alias("score")).orderBy(F.desc("score"), "doc_id")
