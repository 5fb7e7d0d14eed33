"""Scalar classification, routing and gate expressions over text columns. All are built-in expressions unless said otherwise."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# File extensions and interpreters by language.
EXTENSIONS = {
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript", "cjs": "javascript", "mjs": "javascript",
    "py": "python", "pyi": "python", "rs": "rust", "go": "go", "java": "java", "md": "markdown", "markdown": "markdown", "json": "json", "yaml": "yaml", "yml": "yaml",
    "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp", "hh": "cpp", "toml": "toml", "cs": "csharp", "rb": "ruby", "sql": "sql",
    "kt": "kotlin", "kts": "kotlin", "swift": "swift", "sh": "bash", "bash": "bash",
}
INTERPRETERS = {
    "sh": "bash", "bash": "bash", "dash": "bash", "zsh": "bash", "ksh": "bash", "mksh": "bash", "fish": "bash", "python": "python", "node": "javascript", "nodejs": "javascript", "ruby": "ruby",
}
# Names, name endings and value beginnings that mark a secret.
SENSITIVE_NAMES = (
    "ANTHROPIC_API_KEY", "OPENAI_API_KEY", "AWS_ACCESS_KEY_ID", "AWS_SECRET_ACCESS_KEY", "GITHUB_TOKEN", "GH_TOKEN", "DATABASE_URL", "NPM_TOKEN", "STRIPE_SECRET_KEY", "SENTRY_DSN", "SENDGRID_API_KEY",
)
SENSITIVE_SUFFIXES = (
    "_TOKEN", "_SECRET", "_PASSWORD", "_API_KEY", "_SECRET_KEY", "_PRIVATE_KEY", "_ENCRYPTION_KEY", "_SIGNING_KEY", "_ACCESS_KEY", "_HMAC_KEY", "_CREDENTIAL", "_AUTH",
)
CREDENTIAL_PREFIXES = ("sk-ant-", "sk-", "ghp_", "gho_", "ghs_", "ghr_", "github_pat_", "AKIA")
# Level spellings, phrases of refused calls and of failed ones (on lower-cased output).
LEVELS = "ERROR|WARN|WARNING|INFO|DEBUG|TRACE|FATAL|CRITICAL|error|warn|warning|info|debug|trace|fatal|critical|ERR|WRN|INF|DBG|TRC"
DENIALS = "has been denied|user denied|aborted by user|user rejected|permission was denied by user"
ERRORS = r"(^|\n|: )error[:\[]|not found|no such file|permission denied|^fatal:"
# Encodings of models known by their whole name.
ENCODINGS = {
    "cl100k": (
        "gpt-3.5-turbo", "gpt-3.5-turbo-0613", "gpt-3.5-turbo-16k", "gpt-3.5-turbo-16k-0613", "gpt-4", "gpt-4-0314", "gpt-4-32k", "gpt-4-32k-0314", "gpt-4-turbo", "gpt-4-turbo-2024-04-09", "gpt-4-turbo-preview",
    ),
}
MAX_FILE_BYTES = 5 << 20


def _map(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def language_of_path(path: Column) -> Column:
    """By extension; null for unknown ones and for paths with a ``..`` component."""
    ext = F.regexp_extract(path, r"[^/]\.([A-Za-z0-9]+)$", 1)
    return F.when(~path.rlike(r"(^|/)\.\.(/|$)"), _map(EXTENSIONS, ext))


def language_of_shebang(line: Column) -> Column:
    tail = F.regexp_extract(line, r"^#!\s*(?:\S*/)?(?:env\s+(?:-\S+\s+)*)?(?:\S*/)?(\S+)", 1)
    return _map(INTERPRETERS, F.regexp_replace(tail, "[0-9.]+$", ""))


def is_serde(lang: Column) -> Column:
    return lang.isin("json", "yaml", "toml")


def sensitive_key(key: Column) -> Column:
    return F.upper(key).isin(*SENSITIVE_NAMES) | F.upper(key).rlike("(" + "|".join(SENSITIVE_SUFFIXES) + ")$")


def sensitive_value(value: Column) -> Column:
    return (F.octet_length(value) >= 8) & value.rlike("^(" + "|".join(CREDENTIAL_PREFIXES) + ")")


def redact_env(line: Column) -> Column:
    """KEY=VALUE with a sensitive key or value masked, and user:password@ taken out of URLs."""
    key, value = F.regexp_extract(line, r"^(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)=", 1), F.regexp_extract(line, r"^[^=]*=(.*)$", 1)
    plain = F.regexp_replace(line, r"(://)[^:@/\s]+:[^@/\s]+(@)", "$1***$2")
    return F.when((key != "") & (sensitive_key(key) | sensitive_value(value)), F.concat(F.regexp_extract(line, "^([^=]*=)", 1), F.lit("***"))).otherwise(plain)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def is_fenced(text: Column) -> Column:
    t = trimmed(text)
    return t.startswith("```") & t.endswith("```") & (F.octet_length(t) >= 6) & t.contains("\n")


def fence_hint(text: Column) -> Column:
    return F.regexp_extract(text, r"```([A-Za-z0-9_+-]*)", 1)


def is_log_line(line: Column) -> Column:
    """A timestamp, a level or a short bracketed prefix after leading blanks."""
    line = F.regexp_replace(line, r"^\s+|\s+$", "")
    stamp = r"^(\d{4}-\d{2}|\d{10}|\[\d{4}-[^\]]{2})"
    return line.rlike(stamp) | line.rlike(rf"^(?:({LEVELS})(?:$|[: \t])|\[({LEVELS})\])") | line.rlike(r"^\[[^\]]{0,31}\][ :]")


def looks_like_log(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"\S"))
    hits = F.size(F.filter(lines, is_log_line))
    return (hits > 0) & (hits * 2 >= F.size(lines))


def opens_like_json(text: Column) -> Column:
    return trimmed(text).rlike(r"^[{\[]")


def strict_json(text: str | None) -> bool:
    """Whether the whole text is one JSON object or array without repeated keys or non-finite numbers."""
    if not text or text.strip()[:1] not in ("{", "["):
        return False

    def once(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("repeated key")
        return dict(pairs)

    def refuse(name):
        raise ValueError(name)

    try:
        json.loads(text.strip(), object_pairs_hook=once, parse_constant=refuse)
    except (ValueError, RecursionError):
        return False
    return True


def classify(df: DataFrame, col: str = "text") -> DataFrame:
    """``df`` with content_class: code, json, log, mixed or text, the first rule that fits.

    Only texts that open like JSON and are not fenced go through Python, in Arrow batches; the rest stay in the JVM.
    """
    @F.pandas_udf("boolean")
    def parses(s: pd.Series) -> pd.Series:
        return s.map(strict_json)

    t = F.col(col)
    ask = F.when(opens_like_json(t) & ~is_fenced(t), t)
    other = F.when(looks_like_log(t), "log").when(t.contains("```"), "mixed").otherwise("text")
    rows = df.withColumn("__json", parses(ask))
    return rows.withColumn("content_class", F.when(t.isNull(), "text").when(is_fenced(t), "code").when(F.col("__json"), "json").otherwise(other)).drop("__json")


def prefilter(text: Column, kind: Column) -> Column:
    """Whether an engine looks at a block: JSON, log and mixed blocks of 64 bytes to 64 KiB."""
    return kind.isin("json", "log", "mixed") & F.octet_length(text).between(64, 65_536)


def engine(kind: Column) -> Column:
    return F.when(kind.isin("json", "log", "mixed"), kind).otherwise("passthrough")


def is_minified(content: Column) -> Column:
    """Over 500 bytes a line in the first 8192 bytes; without a line end, more than 500 bytes at all."""
    head = F.decode(F.substring(F.encode(content, "UTF-8"), 1, 8192), "ISO-8859-1")
    n, lines = F.length(head), F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))
    return F.when(lines == 0, n > 500).otherwise(F.floor(n / lines) > 500)


def skip_reason(content: Column, lang: Column) -> Column:
    return F.when(lang.isNull(), "unknown_language").when(F.octet_length(content) > MAX_FILE_BYTES, "too_large").when(is_minified(content), "minified")


def looks_like_error(output: Column) -> Column:
    head = F.substring(output, 1, 1024)
    low = F.lower(head)
    return low.rlike(ERRORS) | (low.contains("failed") & ~low.contains("0 failed")) | head.contains("Exit code")


def is_denial(output: Column) -> Column:
    return F.lower(F.substring(output, 1, 512)).rlike(DENIALS)


def command_prefix(command: Column, n: int = 3) -> Column:
    return F.array_join(F.slice(F.split(trimmed(command), r"\s+"), 1, n), " ")


def path_only_difference(a: Column, b: Column) -> Column:
    """As many tokens in both, and every pair that differs contains a slash on both sides; equal commands do not differ."""
    x, y = F.split(trimmed(a), r"\s+"), F.split(trimmed(b), r"\s+")
    pairs = F.zip_with(x, y, lambda p, q: (p == q) | (p.contains("/") & q.contains("/")))
    return (F.size(x) == F.size(y)) & (trimmed(a) != trimmed(b)) & F.forall(pairs, lambda v: F.coalesce(v, F.lit(False)))


def bounded_levenshtein(a: Column, b: Column) -> Column:
    """Edit distance, or the difference of lengths where that exceeds 10; over 500 characters that difference, 11 at least."""
    gap = F.abs(F.length(a) - F.length(b))
    return F.when((F.length(a) > 500) | (F.length(b) > 500), F.greatest(gap, F.lit(11))).when(gap > 10, gap).otherwise(F.levenshtein(a, b))


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, "\x1b(\\[[0-9;?]*[ -/]*[@-~]|\\][^\x07]*\x07)", "")


def lines_of(text: Column) -> Column:
    """Lines without their ends; a final line end makes no further line."""
    return F.transform(F.split(F.regexp_replace(text, "\r?\n$", ""), "\n"), lambda x: F.regexp_replace(x, "\r$", ""))


def truncate_head(text: Column, n: int) -> Column:
    """The first n - 1 lines and a marker with the number left out; texts of up to n lines stay."""
    lines = lines_of(text)
    k = F.size(lines) - n + 1
    return F.when(F.size(lines) <= n, text).otherwise(F.array_join(F.concat(F.slice(lines, 1, n - 1), F.array(F.format_string("... (%d lines truncated)", k))), "\n"))


def truncate_tail(text: Column, n: int) -> Column:
    lines = lines_of(text)
    k = F.size(lines) - n + 1
    return F.when(F.size(lines) <= n, text).otherwise(F.array_join(F.concat(F.array(F.format_string("... (%d lines truncated)", k)), F.slice(lines, -(n - 1), n - 1)), "\n"))


def tidy(text: Column) -> Column:
    """Line ends trimmed and at most two blank lines in a row."""
    return F.regexp_replace(F.regexp_replace(text, r"(?m)[ \t\r]+$", ""), "\n{4,}", "\n\n\n")


def elision_marker(total: Column, shown: Column) -> Column:
    return F.when(total > shown, F.format_string("... %d more (%d of %d shown)", total - shown, shown, total))


def duration_seconds(text: Column) -> Column:
    """``Nh``, ``Nd`` or ``Nw`` in seconds; null otherwise."""
    unit = _map({"h": "3600", "d": "86400", "w": "604800"}, F.regexp_extract(text, r"^\d+([hdw])$", 1)).cast("bigint")
    return F.when(text.rlike(r"^\d{1,9}[hdw]$"), F.regexp_extract(text, r"^(\d+)", 1).try_cast("bigint") * unit)


def bounded_tokens(text: Column) -> Column:
    """A quarter of the bytes for texts over 256 KiB or with a run of over 4 KiB without blanks; else null: count them."""
    n = F.octet_length(text)
    return F.when((n > 262_144) | text.rlike(r"\S{4097}"), F.floor(n / 4))


def offline_tokens(n: Column) -> Column:
    return F.ceil(n * 1.25)


def encoding_for_model(model: Column) -> Column:
    exact = F.when(model.isin(*ENCODINGS["cl100k"]), "cl100k")
    known = F.when(model.rlike("^(gpt-|o1|o3|o4|chatgpt-)"), "o200k").when(model.startswith("claude-"), "offline")
    return F.coalesce(exact, known, F.lit("heuristic"))


def byte_gate(before: Column, after: Column) -> Column:
    """What a block becomes: the candidate unless it is longer in bytes."""
    return F.when(F.octet_length(after) <= F.octet_length(before), after).otherwise(before)


def keeps_savings(before: Column, after: Column) -> Column:
    return F.octet_length(trimmed(after)) < F.octet_length(trimmed(before))


def guardrail(raw: Column, out: Column, raw_tokens: Column, out_tokens: Column) -> Column:
    """Raw output if the rendered one has more bytes and more tokens; short raw outputs always pass as they are rendered."""
    worse = (F.octet_length(out) > F.octet_length(raw)) & (out_tokens > raw_tokens)
    return F.when((F.octet_length(raw) >= 256) & worse, raw).otherwise(out)


def safe_session(session: Column) -> Column:
    return F.coalesce(session.rlike(r"^[A-Za-z0-9._-]{1,128}$"), F.lit(False))


def hunk_header(line: Column) -> list[Column]:
    """old_start, old_count, new_start, new_count of a diff hunk; a missing count is 1."""
    rx = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
    part = lambda i: F.regexp_extract(line, rx, i)
    num = lambda i, d: F.when(part(i) == "", d).otherwise(part(i).try_cast("bigint"))
    return [num(1, None).alias("old_start"), F.when(part(1) != "", num(2, 1)).alias("old_count"), num(3, None).alias("new_start"), F.when(part(1) != "", num(4, 1)).alias("new_count")]


def rename_target(path: Column) -> Column:
    """``pre{old => new}post`` becomes ``prenewpost``."""
    return F.regexp_replace(path, r"^([^{]*)\{.* => (.*)\}(.*)$", "$1$2$3")


def line_range(lines: Column) -> Column:
    """From the first to behind the last of some line numbers (from 1); without any, 0 to 0."""
    some = F.size(lines) > 0
    end = lambda c, more: F.when(F.coalesce(some, F.lit(False)), c + more).otherwise(0).cast("int")
    return F.struct(end(F.array_min(lines), 0).alias("start"), end(F.array_max(lines), 1).alias("end"))
