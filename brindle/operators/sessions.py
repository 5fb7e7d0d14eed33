"""Session mining over tool invocations: session_id, seq, tool, command, is_error, result.

Lookaheads are joins or frames bounded by a few rows within a session; nothing gathers a session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.parsers import match_rewrites
from brindle.functions.text import bounded_levenshtein, command_prefix, is_denial, language_of_path, looks_like_error, path_only_difference, trimmed

LOOKAHEAD, TDD_LOOKAHEAD = 5, 10


def failed(df: DataFrame) -> DataFrame:
    return df.withColumn("failed", F.coalesce("is_error", F.lit(False)) | F.coalesce(looks_like_error(F.col("result")), F.lit(False)))


def _tokens(c: str) -> Column:
    return F.split(trimmed(F.col(c)), r"\s+")


def correction_kind() -> Column:
    """Of a failed and a later command: typo, missing_separator, missing_arg, wrong_flag, or null where neither fits."""
    a, b = _tokens("command"), _tokens("fixed")
    base = bounded_levenshtein(a[0], b[0])
    whole = bounded_levenshtein(F.col("command"), F.col("fixed"))
    by_count = F.when(F.size(a) == F.size(b), F.when(F.exists(F.zip_with(a, b, lambda x, y: (x != y) & x.startswith("-")), lambda v: F.coalesce(v, F.lit(False))), "wrong_flag").otherwise("typo")).otherwise("missing_arg")
    shared = F.when((F.slice(a, 1, 2) == F.slice(b, 1, 2)) & (F.size(a) >= 2), F.when(F.size(b) > F.size(a), "missing_arg").otherwise("wrong_flag"))
    return (
        F.when(a[0] != b[0], F.when(base <= 2, "typo"))
        .when(F.col("fixed").contains(" -- ") & ~F.col("command").contains(" -- "), "missing_separator")
        .when(whole <= 3, by_count)
        .otherwise(shared)
    )


def tdd_cycles(calls: DataFrame) -> DataFrame:
    """Failed calls whose next TDD_LOOKAHEAD calls with the same prefix change between error and success twice or more."""
    rows = failed(calls).withColumn("prefix", command_prefix(F.col("command")))
    frame = Window.partitionBy("session_id").orderBy("seq").rowsBetween(1, TDD_LOOKAHEAD)
    ahead = F.filter(F.collect_list(F.struct("prefix", "failed")).over(frame), lambda x: x["prefix"] == F.col("prefix"))
    state = F.aggregate(ahead, F.struct(F.lit(True).alias("last"), F.lit(0).alias("n")), lambda s, x: F.struct(x["failed"].alias("last"), (s["n"] + F.when(x["failed"] != s["last"], 1).otherwise(0)).alias("n")))
    return rows.withColumn("changes", state["n"]).filter("failed AND changes >= 2").select("session_id", "seq")


def corrections(calls: DataFrame) -> DataFrame:
    """session_id, seq, command, fixed, kind: a failed call and the first success within LOOKAHEAD calls that corrects it."""
    rows = failed(calls)
    wrong = rows.filter(F.col("failed") & ~F.coalesce(is_denial(F.col("result")), F.lit(False))).join(tdd_cycles(calls), ["session_id", "seq"], "left_anti")
    steps = wrong.select("session_id", "seq", "command", F.explode(F.sequence(F.lit(1), F.lit(LOOKAHEAD))).alias("step")).withColumn("at", F.col("seq") + F.col("step"))
    right = rows.filter(~F.col("failed")).select("session_id", F.col("seq").alias("at"), F.col("command").alias("fixed"))
    pairs = steps.join(right, ["session_id", "at"]).filter(F.col("command") != F.col("fixed")).withColumn("kind", correction_kind()).filter("kind IS NOT NULL")
    best = F.min_by(F.struct("fixed", "kind"), "at")
    return pairs.groupBy("session_id", "seq", "command").agg(best.alias("b")).select("session_id", "seq", "command", "b.fixed", "b.kind")


def correction_rules(found: DataFrame, least: int = 3) -> DataFrame:
    """Corrections by the prefixes of both commands that occur ``least`` times and are no mere change of paths."""
    rows = found.filter(~path_only_difference(F.col("command"), F.col("fixed")))
    return rows.groupBy(command_prefix(F.col("command")).alias("wrong"), command_prefix(F.col("fixed")).alias("right")).agg(F.count("*").alias("occurrences"), F.count_distinct("session_id").alias("sessions")).filter(F.col("occurrences") >= least)


def discover(calls: DataFrame, share: float = 0.7) -> DataFrame:
    """Calls by command prefix: how many, tokens of their results (a quarter of the bytes), and what reduction might save."""
    tokens = F.floor(F.coalesce(F.octet_length("result"), F.lit(0)) / 4)
    return calls.groupBy(command_prefix(F.col("command"), 1).alias("command")).agg(F.count("*").alias("calls"), F.sum(tokens).alias("tokens"), F.sum(F.floor(tokens * share)).alias("potential")).orderBy(F.desc("calls"), "command")


# Names of calls that read a file, and that run a command.
READS, SHELLS = ("Read", "read_file"), ("Bash", "bash", "shell")


def discover_reads(calls: DataFrame, share: float = 0.7) -> DataFrame:
    """One row: calls, file reads, code reads (of a language that is known by its path), tokens of all reads (a quarter of their
    bytes), and what shorter modes might save of the code that was read."""
    read = F.col("tool").isin(*READS)
    code = read & F.coalesce(language_of_path(F.col("command")).isNotNull(), F.lit(False))
    tokens = F.floor(F.coalesce(F.octet_length("result"), F.lit(0)) / 4)
    return calls.agg(F.count("*").alias("calls"), F.count_if(read).alias("reads"), F.count_if(code).alias("code_reads"), F.coalesce(F.sum(F.when(read, tokens)), F.lit(0)).alias("read_tokens"), F.coalesce(F.sum(F.when(code, F.floor(tokens * share))), F.lit(0)).alias("potential"))


def unhandled_commands(calls: DataFrame, rules: list[tuple[str, str, tuple[str, ...]]]) -> DataFrame:
    """prefix (three words), n of shell calls that no rewrite rule knows, the most frequent first."""
    runs = calls.filter(F.col("tool").isin(*SHELLS)).select(F.struct("session_id", "seq").alias("cmd_id"), "command")
    left = runs.join(match_rewrites(runs, rules).filter("rewritten IS NOT NULL").select("cmd_id"), "cmd_id", "left_anti")
    prefix = command_prefix(F.col("command"))
    return left.filter(prefix != "").groupBy(prefix.alias("prefix")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "prefix")
