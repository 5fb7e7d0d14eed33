"""Readers of textual sources: history logs, session transcripts, source trees."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions.parsers import glob_regex
from brindle.functions.text import is_minified, language_of_path, rename_target, skip_reason


def parse_history_log(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(commits, changes) of log lines (source, line_no, line): ``COMMIT:hash|author|seconds|subject``, then numstat rows.

    Binary rows (``-``) go; unreadable counts are 0. A row belongs to the last header before it in its source: a window by
    source, so give each repository or dump part its own source.
    """
    w = Window.partitionBy("source").orderBy("line_no")
    rows = lines.withColumn("n", F.count_if(F.col("line").startswith("COMMIT:")).over(w))
    head = F.split(F.substring("line", 8, 1 << 20), r"\|", 4)
    commits = rows.filter(F.col("line").startswith("COMMIT:") & (F.size(head) == 4)).select("source", "n", head[0].alias("hash"), head[1].alias("author"), head[2].try_cast("bigint").alias("ts"), head[3].alias("message")).filter("ts IS NOT NULL")
    part = F.split("line", "\t", 3)
    stat = rows.filter(~F.col("line").startswith("COMMIT:") & (F.size(part) == 3) & ~((part[0] == "-") & (part[1] == "-")))
    count = lambda c: F.coalesce(c.try_cast("bigint"), F.lit(0))
    changes = stat.select("source", "n", count(part[0]).alias("additions"), count(part[1]).alias("deletions"), rename_target(part[2]).alias("path"))
    return commits.drop("n"), changes.join(commits, ["source", "n"]).select("hash", "ts", "author", "message", "path", "additions", "deletions")


CONTENT = "array<struct<type:string,id:string,name:string,input:string,tool_use_id:string,content:string,is_error:boolean>>"


def parse_sessions_blocks(lines: DataFrame) -> DataFrame:
    """The content blocks of message lines, numbered within their line."""
    return lines.select("session_id", "line_no", F.posexplode(F.from_json(F.get_json_object("line", "$.message.content"), CONTENT)).alias("k", "b")).select("session_id", "line_no", "k", "b.*")


def parse_sessions(lines: DataFrame) -> DataFrame:
    """session_id, seq, tool, command, is_error, result of transcript lines (session_id, line_no, line), one JSON each.

    Calls are joined to later results by id; malformed lines and results without a call are left out.
    """
    blocks = parse_sessions_blocks(lines)
    flat = lines.filter(F.get_json_object("line", "$.type").isin("tool_use", "tool_result")).select(
        "session_id", "line_no", F.lit(0).alias("k"), F.get_json_object("line", "$.type").alias("type"), F.get_json_object("line", "$.id").alias("id"), F.get_json_object("line", "$.tool").alias("name"),
        F.get_json_object("line", "$.args").alias("input"), F.get_json_object("line", "$.tool_use_id").alias("tool_use_id"), F.get_json_object("line", "$.content").alias("content"), F.get_json_object("line", "$.is_error").try_cast("boolean").alias("is_error"),
    )
    both = blocks.unionByName(flat)
    uses = both.filter("type = 'tool_use'").select("session_id", "line_no", "k", "id", F.col("name").alias("tool"), F.coalesce(F.get_json_object("input", "$.command"), F.get_json_object("input", "$.file_path")).alias("command"))
    results = both.filter("type = 'tool_result'").groupBy("session_id", F.col("tool_use_id").alias("id")).agg(F.min_by("content", "line_no").alias("result"), F.min_by("is_error", "line_no").alias("is_error"))
    seq = F.row_number().over(Window.partitionBy("session_id").orderBy("line_no", "k"))
    return uses.withColumn("seq", seq).join(results, ["session_id", "id"], "left").select("session_id", "seq", "tool", "command", "is_error", "result")


def parse_call_sessions(lines: DataFrame) -> DataFrame:
    """As ``parse_sessions``, for transcripts whose lines hold blocks of which the first call counts, and whose results are not kept."""
    every = parse_sessions_blocks(lines).filter("type = 'tool_use'")
    uses = every.withColumn("n", F.row_number().over(Window.partitionBy("session_id", "line_no").orderBy("k"))).filter("n = 1")
    none = lines.limit(0).select("session_id", "line_no", F.lit("").alias("id"), F.lit("").alias("result"), F.lit(False).alias("is_error"))
    return _join_results(uses.select("session_id", "line_no", "k", "id", F.col("name").alias("tool"), "input"), none)


FLAT_LAYOUTS = {
    # By layout, event type and fields of calls, then of results: id, name, arguments; id, content, error.
    "codex": (("codex.tool_decision", "tool_decision_id", "tool", "args"), ("codex.tool_result", "tool_decision_id", "result.content", "result.is_error")),
    "copilot": (("tool_use", "id", "toolName", "toolArgs"), ("tool_result", "toolUseId", "content", "resultType")),
}


def _join_results(uses: DataFrame, results: DataFrame) -> DataFrame:
    """Calls (session_id, line_no, k, id, tool, input) numbered in order, with the first result of their id."""
    arg = lambda n: F.get_json_object("input", f"$.{n}")
    first = results.groupBy("session_id", "id").agg(F.min_by("result", "line_no").alias("result"), F.min_by("is_error", "line_no").alias("is_error"))
    seq = F.row_number().over(Window.partitionBy("session_id").orderBy("line_no", "k"))
    rows = uses.withColumn("command", F.coalesce(arg("command"), arg("file_path"), arg("path"), arg("pattern"))).withColumn("seq", seq)
    return rows.join(first, ["session_id", "id"], "left").select("session_id", "seq", "tool", "command", "is_error", "result")


def parse_flat_sessions(lines: DataFrame, layout: str) -> DataFrame:
    """As ``parse_sessions``, for transcripts with one call or result a line (codex, copilot). Malformed lines are left out."""
    (use, uid, name, args), (done, rid, content, error) = FLAT_LAYOUTS[layout]
    get = lambda p: F.get_json_object("line", f"$.{p}")
    uses = lines.filter(get("type") == use).select("session_id", "line_no", F.lit(0).alias("k"), get(uid).alias("id"), get(name).alias("tool"), get(args).alias("input"))
    failed = (get(error) == "error") if layout == "copilot" else get(error).try_cast("boolean")
    return _join_results(uses, lines.filter(get("type") == done).select("session_id", "line_no", get(rid).alias("id"), get(content).alias("result"), failed.alias("is_error")))


CURSOR = "struct<composerData:struct<conversations:array<struct<messages:array<struct<role:string,content:string,tool_call_id:string,tool_calls:array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>>>>>>>"


def parse_nested_sessions(blobs: DataFrame) -> DataFrame:
    """As ``parse_sessions``, for key-value stores that hold a JSON value of conversations each (session_id, value)."""
    conversations = F.from_json("value", CURSOR)["composerData"]["conversations"]
    rows = blobs.select("session_id", F.posexplode(F.flatten(F.transform(conversations, lambda c: c["messages"]))).alias("line_no", "m")).select("session_id", "line_no", "m.*")
    uses = rows.filter("role = 'assistant'").select("session_id", "line_no", F.posexplode("tool_calls").alias("k", "c")).filter("c.type = 'function'")
    uses = uses.select("session_id", "line_no", "k", "c.id", F.col("c.function.name").alias("tool"), F.col("c.function.arguments").alias("input"))
    return _join_results(uses, rows.filter("role = 'tool'").select("session_id", "line_no", F.col("tool_call_id").alias("id"), F.col("content").alias("result"), F.lit(None).cast("boolean").alias("is_error")))


def lines_or_array(texts: DataFrame) -> DataFrame:
    """session_id, line_no, line of whole transcripts (session_id, text): JSON lines, or one JSON array of such objects."""
    many = F.from_json("text", "array<string>")
    parts = F.when(F.col("text").rlike(r"^\s*\["), many).otherwise(F.split("text", "\n"))
    return texts.select("session_id", F.posexplode(parts).alias("line_no", "line")).filter(F.col("line").rlike(r"\S"))


def read_tree(spark: SparkSession, root: str, globs: tuple[str, ...] = (), ignore: tuple[str, ...] = ()) -> DataFrame:
    """path, content, lang, sha256, skip_reason of every file below a folder that any Spark file system can list.

    ``globs``: only paths (below the folder) that one of them fits. ``ignore``: rules as in ignore files, in order; the last
    one that fits decides, ``!`` takes back, a rule with a slash inside or before it is tied to the folder, one that ends
    with a slash fits folders, and a file below an ignored folder is ignored. Ignored and hidden files are not read.
    """
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    top = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    place = F.regexp_replace(F.regexp_replace("path", "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), f"^{re.escape(top)}/", "")
    raw = raw.withColumn("place", place).filter(~F.col("place").rlike(r"(^|/)\."))
    if globs:
        raw = raw.filter(F.col("place").rlike("|".join(map(glob_regex, globs))))
    if ignore:
        raw = raw.filter(~ignored(F.col("place"), ignore))
    rows = raw.select("path", "content", F.sha2("content", 256).alias("sha256"), F.is_valid_utf8(F.col("content").cast("string")).alias("utf8"))
    text = F.when(F.col("utf8"), F.col("content").cast("string"))
    lang = language_of_path(F.col("path"))
    return rows.select("path", text.alias("content"), lang.alias("lang"), "sha256", F.coalesce(F.when(~F.col("utf8"), "not_utf8"), skip_reason(text, lang)).alias("skip_reason"))


def ignored(path: Column, rules: tuple[str, ...]) -> Column:
    """Whether ignore rules leave a path (relative, with slashes) out; see ``read_tree``. Blank rules and comments do nothing."""
    out = F.lit(False)
    for rule in rules:
        body = rule.strip()
        if not body or body.startswith("#"):
            continue
        back, body = body.startswith("!"), body.removeprefix("!")
        folder, tied = body.endswith("/"), "/" in body.rstrip("/")
        body = body.strip("/")
        parts = re.split(r"(\*\*/|/\*\*$|\*\*|\*|\?)", body)
        same = {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}
        rx = "".join(same.get(p, re.escape(p)) for p in parts if p)
        fits = path.rlike(("^" if tied else "(?:^|/)") + rx + ("/" if folder else "(?:/|$)"))
        out = F.when(fits, F.lit(not back)).otherwise(out)
    return out


def changed_files(now: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose (path, sha256) the manifest lacks: what an incremental refresh reads again."""
    return now.join(manifest.select("path", "sha256"), ["path", "sha256"], "left_anti")


__all__ = ["parse_history_log", "parse_sessions", "read_tree", "changed_files", "is_minified"]
