"""Command output to canonical tables. Every parser works on lines (doc_id, pos, line) or whole outputs (doc_id, text) in
built-in functions and reports its tier: full, degraded (some of it read) or passthrough (nothing known in it)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import hunk_header, lines_of

# Files, folders and file name endings that count as generated or vendored.
DENIED_NAMES = ("Cargo.lock", "package-lock.json", "yarn.lock", "go.sum", "poetry.lock", "pnpm-lock.yaml", "Pipfile.lock", "Gemfile.lock", "composer.lock", "flake.lock")
DENIED_DIRS = ("vendor", "node_modules", "dist", "build", "target", ".git", "__pycache__", ".tox")
DENIED_SUFFIXES = r"(min\.js|min\.css|pb\.go|generated\.go)$"
# Path globs that history metrics leave out.
EXCLUDES = (
    "Cargo.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "Pipfile.lock", "composer.lock", "Gemfile.lock", "go.sum", "*.lock", "dist/**", "build/**", "target/**", "out/**",
    ".next/**", ".nuxt/**", "__pycache__/**", "*.egg-info/**", "*.min.js", "*.min.css", "*.bundle.js", "*.chunk.js", "*.log", "logs/**", "vendor/**", "node_modules/**", ".idea/**", ".vscode/**",
    ".DS_Store", "coverage/**", ".nyc_output/**", "migrations/**/*.sql",
)


def glob_regex(pattern: str) -> str:
    """A whole-path regular expression: ``*`` crosses folders, ``**/`` is any number of them, ``?`` one character."""
    parts = re.split(r"(\*\*/|\*+|\?)", pattern)
    return "^" + "".join({"**/": "(?:.*/)?", "?": "."}.get(p, ".*" if p.startswith("*") else re.escape(p)) for p in parts if p) + "$"


def is_excluded(path: Column, extra: tuple[str, ...] = ()) -> Column:
    return path.rlike("|".join(map(glob_regex, (*EXCLUDES, *extra))))


def to_lines(outputs: DataFrame, col: str = "text") -> DataFrame:
    return outputs.select("doc_id", F.posexplode(lines_of(F.col(col))).alias("pos", "line"))


def is_denied(path: Column) -> Column:
    parts = F.split(F.translate(path, "\\", "/"), "/")
    return F.element_at(parts, -1).isin(*DENIED_NAMES) | F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, DENIED_DIRS))) | path.rlike(DENIED_SUFFIXES)


def _count(text: Column, rx: str) -> Column:
    return F.coalesce(F.regexp_extract(text, rx, 1).try_cast("bigint"), F.lit(0))


def test_summary(outputs: DataFrame) -> DataFrame:
    """doc_id, passed, failed, skipped, duration_s, tier of test runner outputs with ``N passed, M failed in S s`` lines."""
    t = F.col("text")
    out = outputs.select("doc_id", _count(t, r"(\d+) passed").alias("passed"), _count(t, r"(\d+) failed").alias("failed"), _count(t, r"(\d+) (?:skipped|ignored)").alias("skipped"), F.regexp_extract(t, r"in ([0-9.]+) ?s", 1).try_cast("double").alias("duration_s"))
    known = F.col("passed") + F.col("failed") + F.col("skipped") > 0
    return out.withColumn("tier", F.when(known & F.col("duration_s").isNotNull(), "full").when(known, "degraded").otherwise("passthrough"))


def failing_tests(lines: DataFrame) -> DataFrame:
    """doc_id, pos, name of failing entries in verbose (``name FAILED``), summary (``FAILED name``) and ``test name ... FAILED`` lines."""
    line = F.col("line")
    name = F.coalesce(*(F.nullif(F.regexp_extract(line, rx, 1), F.lit("")) for rx in (r"^test (\S+) \.\.\. FAILED$", r"^FAILED (\S+)", r"^(\S+::\S+) FAILED")))
    return lines.select("doc_id", "pos", name.alias("name")).filter("name IS NOT NULL")


def build_summary(lines: DataFrame) -> DataFrame:
    """doc_id, errors, warnings, success, first_error of compiler outputs."""
    line = F.col("line")
    error, warning = line.rlike(r"(?i)(^|[\s:(])(fatal )?error(\[[A-Z0-9]+\]|\s*[A-Z]{1,3}\d+)?:"), line.rlike(r"(?i)(^|[\s:(])warning(\[[A-Za-z0-9_-]+\])?:")
    return lines.groupBy("doc_id").agg(F.count_if(error).alias("errors"), F.count_if(warning & ~error).alias("warnings"), (F.count_if(error) == 0).alias("success"), F.min_by("line", F.when(error, F.col("pos"))).alias("first_error"))


def lint_issues(lines: DataFrame) -> DataFrame:
    """doc_id, pos, file, line, severity, message, rule of ``file:line[:col]: severity: message [rule]`` lines."""
    rx = r"^([^:\s][^:]*):(\d+):(?:\d+:)?\s*(error|warning|note|info):\s*(.*?)(?:\s+\[([\w/-]+)\])?$"
    part = lambda i: F.regexp_extract("line", rx, i)
    return lines.filter(F.col("line").rlike(rx)).select("doc_id", "pos", part(1).alias("file"), part(2).try_cast("bigint").alias("line"), F.when(part(3) == "note", "info").otherwise(part(3)).alias("severity"), part(4).alias("message"), F.when(part(5) != "", part(5)).otherwise("unknown").alias("rule"))


def status_summary(lines: DataFrame) -> DataFrame:
    """doc_id, branch, ahead, behind, staged, unstaged, untracked, conflicts of porcelain-v2 status lines."""
    line = F.col("line")
    entry = line.rlike(r"^[12] ")
    xy = lambda i: F.substring("line", 2 + i, 1) != "."
    first = lambda rx: F.max(F.when(line.rlike(rx), F.regexp_extract(line, rx, 1)))
    return lines.groupBy("doc_id").agg(
        first(r"^# branch\.head (.*)$").alias("branch"), first(r"^# branch\.ab \+(\d+) ").try_cast("bigint").alias("ahead"), first(r"^# branch\.ab \+\d+ -(\d+)").try_cast("bigint").alias("behind"),
        F.count_if(entry & xy(1)).alias("staged"), F.count_if(entry & xy(2)).alias("unstaged"), F.count_if(line.startswith("? ")).alias("untracked"), F.count_if(line.startswith("u ")).alias("conflicts"),
    )


def log_subjects(lines: DataFrame) -> DataFrame:
    """doc_id, pos, hash, subject of one-line history."""
    return lines.filter(F.col("line").rlike(r"^[0-9a-f]{7,40} ")).select("doc_id", "pos", F.regexp_extract("line", r"^([0-9a-f]+) ", 1).alias("hash"), F.regexp_extract("line", r"^[0-9a-f]+ (?:\([^)]*\) )?(.*)$", 1).alias("subject"))


def table_rows(outputs: DataFrame, separator: str = r"\|") -> DataFrame:
    """doc_id, columns, rows of query output: a header, a rule line, then cells between separators; ``(N rows)`` ends it."""
    lines = F.filter(lines_of(F.col("text")), lambda x: x.rlike(separator) & ~x.rlike(r"^[-+|= ]+$") & ~x.rlike(r"^\(\d+ rows?\)$"))
    cells = F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\s*\||\|\s*$", ""), separator), lambda c: F.trim(c)))
    return outputs.select("doc_id", cells.alias("c")).select("doc_id", F.coalesce(F.try_element_at("c", F.lit(1)), F.array().cast("array<string>")).alias("columns"), F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(0))).alias("rows"))


def diff_lines(lines: DataFrame) -> DataFrame:
    """doc_id, pos, file, hunk, mark, new_line of a unified diff's body lines.

    ``+`` and context lines stand at their number in the new file; ``-`` marks the number that follows and does not advance.
    Running sums by document order; a document is one diff.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    head = hunk_header(F.col("line"))
    is_head = F.col("line").rlike(r"^@@ -\d+(,\d+)? \+\d+(,\d+)? @@")
    rows = lines.withColumn("file", F.last(F.when(F.col("line").startswith("+++ "), F.regexp_replace(F.substring("line", 5, 1 << 16), "^b/", "")), ignorenulls=True).over(w))
    rows = rows.withColumn("hunk", F.count_if(is_head).over(w)).withColumn("start", F.when(is_head, head[2])).withColumn("is_head", is_head)
    rows = rows.withColumn("meta", F.col("line").rlike(r"^(diff --git |index |--- |\+\+\+ |new file|deleted file|old mode|new mode|similarity|rename |Binary )"))
    h = Window.partitionBy("doc_id", "hunk").orderBy("pos")
    step = F.when(~F.col("is_head") & ~F.col("meta") & F.col("line").rlike(r"^[+ ]"), 1).otherwise(0)
    rows = rows.withColumn("base", F.first("start", ignorenulls=True).over(h)).withColumn("before", F.sum(step).over(h) - step)
    body = rows.filter("hunk > 0 AND NOT is_head AND NOT meta").filter(F.col("line").rlike(r"^[-+ ]"))
    return body.select("doc_id", "pos", "file", "hunk", F.substring("line", 1, 1).alias("mark"), (F.col("base") + F.col("before")).alias("new_line"))


def match_rewrites(commands: DataFrame, rules: list[tuple[str, str, tuple[str, ...]]]) -> DataFrame:
    """cmd_id, rewritten of commands (cmd_id, command): rules are (prefix, replacement, flags that exclude it), in order.

    Leading VAR=value words stay in front. The first rule whose prefix words match decides; if a flag excludes it, there is no
    rewrite at all. Rules are part of the plan, a few dozen at most.
    """
    env = F.regexp_extract("command", r"^((?:[A-Za-z_]\w*=\S*\s+)*)", 1)
    words = F.split(F.trim(F.regexp_replace("command", r"^(?:[A-Za-z_]\w*=\S*\s+)*", "")), r"\s+")
    out = None
    for prefix, replacement, excluded in rules:
        p = prefix.split()
        fits = F.slice(F.col("w"), 1, len(p)) == F.array(*map(F.lit, p))
        rest = F.slice(F.col("w"), len(p) + 1, 1 << 16)
        new = F.concat(F.col("env"), F.array_join(F.concat(F.array(F.lit(replacement)), rest), " "))
        value = F.when(~F.arrays_overlap(rest, F.array(*map(F.lit, excluded))), new) if excluded else new
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return commands.select("cmd_id", env.alias("env"), words.alias("w")).select("cmd_id", (out if out is not None else F.lit(None).cast("string")).alias("rewritten"))


def classify_commands(commands: DataFrame, rules: list[tuple[str, str, tuple[str, ...]]], compact: tuple[str, ...] = (), own: tuple[str, ...] = ()) -> DataFrame:
    """cmd_id, kind, rewritten of commands (cmd_id, command): rewritten where a rule gives a new command, already_compact where
    every segment begins with one of the ``compact`` prefixes, else unhandled.

    Compound commands are taken apart: segments that a rule knows are replaced where they stand, the rest stays. Blank
    commands, those of our ``own`` tools and those that can't be taken apart or put together again byte by byte (line
    breaks, substitutions, runs of blanks) are unhandled.
    """
    from brindle.functions.shell import split_column

    whole = commands.select("cmd_id", F.trim("command").alias("command"))
    safe = whole.filter(F.col("command").isNotNull() & (F.col("command") != "") & ~F.col("command").rlike(r"[\n\r\t]| {2}|[`]|\$[({]|<<") & ~F.col("command").rlike(f"^(?:{'|'.join(map(re.escape, own)) or '(?!)'})(?: |$)"))
    parts = safe.select("cmd_id", F.posexplode(split_column(F.col("command"))).alias("pos", "s")).select("cmd_id", "pos", "s.command", "s.operator", "s.redirects")
    key = F.concat_ws("|", F.col("cmd_id").cast("string"), F.col("pos").cast("string"))
    found = match_rewrites(parts.select(key.alias("cmd_id"), "command"), rules).withColumnRenamed("cmd_id", "part")
    rows = parts.withColumn("part", key).join(found, "part")
    known = F.lit(False)
    for prefix in compact:
        known = known | (F.col("command") == prefix) | F.col("command").startswith(f"{prefix} ")
    text = F.concat_ws(" ", F.coalesce("rewritten", "command"), F.array_join("redirects", " "))
    text = F.concat(F.rtrim(text), F.when(F.col("operator") == ";", "; ").when(F.col("operator").isNotNull(), F.concat(F.lit(" "), F.col("operator"), F.lit(" "))).otherwise(""))
    each = rows.groupBy("cmd_id").agg(F.max(F.col("rewritten").isNotNull()).alias("new"), F.min(known).alias("compact"), F.sort_array(F.collect_list(F.struct("pos", text.alias("text")))).alias("l"))
    kind = F.when(F.col("new"), "rewritten").when(F.col("compact"), "already_compact").otherwise("unhandled")
    return whole.select("cmd_id").join(each, "cmd_id", "left").select("cmd_id", kind.alias("kind"), F.when(F.col("new"), F.array_join("l.text", "")).alias("rewritten"))
