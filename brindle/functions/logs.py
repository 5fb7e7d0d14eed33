"""Log reduction: lines to entries, deduplicated by level and message in first-seen order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STAMP = r"^\[?\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?\]?\s*"
LEVEL = r"^(?:\[([A-Za-z]+)\]\s*|(TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL|CRITICAL):\s*)(.*)$"
HIDDEN = ("DEBUG", "TRACE")


def strip_stamp(line: Column) -> Column:
    return F.regexp_replace(line, STAMP, "")


def entries(lines: DataFrame, *carry: str) -> DataFrame:
    """doc_id, pos, ts, level, message (and ``carry``) of every line that is not blank (columns doc_id, pos, line)."""
    rest = strip_stamp(F.col("line"))
    level = F.upper(F.concat(F.regexp_extract(rest, LEVEL, 1), F.regexp_extract(rest, LEVEL, 2)))
    stamp = F.trim(F.regexp_extract(F.col("line"), STAMP, 0))
    return lines.filter(F.col("line").rlike(r"\S")).select(
        "doc_id", "pos", F.when(stamp != "", stamp).alias("ts"), F.when(level != "", level).alias("level"),
        F.when(level != "", F.regexp_extract(rest, LEVEL, 3)).otherwise(rest).alias("message"), *carry,
    )


def deduplicate(rows: DataFrame, lossless: bool = False, keep_debug: bool = False, *carry: str) -> DataFrame:
    """One row for each (document, level, message): count, first position, first spelling, first and last stamp by position.
    ``carry`` are columns with one value a document.

    Messages are compared without case unless ``lossless``. Aggregated before the shuffle; long runs of one line are one row.
    """
    some = rows if keep_debug else rows.filter(~F.coalesce(F.col("level").isin(*HIDDEN), F.lit(False)))
    key = F.col("message") if lossless else F.lower("message")
    seen = F.when(F.col("ts").isNotNull(), F.col("pos"))
    out = some.groupBy("doc_id", *carry, F.coalesce("level", F.lit("")).alias("lv"), key.alias("k")).agg(
        F.min("pos").alias("pos"), F.min_by("message", "pos").alias("message"), F.count("*").alias("count"),
        F.min_by("ts", seen).alias("min_timestamp"), F.max_by("ts", seen).alias("max_timestamp"),
    )
    return out.select("doc_id", *carry, "pos", F.when(F.col("lv") != "", F.col("lv")).alias("level"), "message", "count", "min_timestamp", "max_timestamp")


def totals(rows: DataFrame) -> DataFrame:
    """Per document: lines, unique entries, hidden debug lines, and duplicates, never below 0."""
    hidden = F.coalesce(F.col("level").isin(*HIDDEN), F.lit(False))
    shown = F.struct(F.coalesce("level", F.lit("")).alias("l"), F.lower("message").alias("m"))
    out = rows.groupBy("doc_id").agg(F.count("*").alias("total"), F.count_if(hidden).alias("hidden"), F.count_distinct(F.when(~hidden, shown)).alias("unique_entries"))
    return out.withColumn("duplicates", F.greatest(F.col("total") - F.col("unique_entries") - F.col("hidden"), F.lit(0)))


def json_level(line: Column) -> Column:
    keys = [F.get_json_object(line, f"$.{k}") for k in ("level", "severity", "lvl", "log_level")]
    return F.upper(F.substring(F.coalesce(*keys), 1, 32))


def json_text(line: Column) -> Column:
    """The message of a JSON line, whole."""
    return F.coalesce(*(F.get_json_object(line, f"$.{k}") for k in ("msg", "message", "text", "body")))


def json_message(line: Column) -> Column:
    """The message of a JSON line for display: cut after 16,384 characters."""
    m = json_text(line)
    return F.when(F.length(m) > 16_384, F.concat(F.substring(m, 1, 16_384), F.lit("[truncated]"))).otherwise(m)


def group_issues(issues: DataFrame) -> DataFrame:
    """Lint issues (pos, rule, severity, file, line) by rule: count, the first one's severity and place, and the number of files.

    Aggregated before the shuffle; the places themselves are ``issue_places``, rows and not an array in one task.
    """
    place = F.concat_ws(":", "file", F.col("line").cast("string"))
    out = issues.groupBy("rule").agg(F.count("*").alias("count"), F.min_by("severity", "pos").alias("severity"), F.min_by(place, "pos").alias("first"), F.count_distinct("file").alias("files"))
    return out.orderBy("rule")


def issue_places(issues: DataFrame) -> DataFrame:
    """rule, pos, place of every issue, in input order by rule."""
    return issues.select("rule", "pos", F.concat_ws(":", "file", F.col("line").cast("string")).alias("place")).orderBy("rule", "pos")


def last_frames(frames: DataFrame, keep: int = 3) -> DataFrame:
    """Stack frames (doc_id, entry, pos, frame): the last ``keep`` of each entry and how many were left out. Only kept ones are gathered."""
    back = F.row_number().over(Window.partitionBy("doc_id", "entry").orderBy(F.desc("pos")))
    kept = F.sort_array(F.collect_list(F.when(F.col("back") <= keep, F.struct("pos", "frame"))))
    out = frames.withColumn("back", back).groupBy("doc_id", "entry").agg(kept.alias("f"), F.count_if(F.col("back") > keep).alias("elided"))
    return out.select("doc_id", "entry", F.col("f.frame").alias("frames"), F.col("elided").cast("int").alias("elided"))


FRAME = r"^\s+(?:at\s|File\s+\")"


def structured(docs: DataFrame) -> DataFrame:
    """doc_id, tier, pos, ts, level, message, elided of whole logs (doc_id, text), one row an entry.

    tier full: the first line with words is JSON, and each line gives its level and whole message (lines that are no JSON stay
    as they are). degraded: some line has a time, a level or is a stack frame; frames go to the entry before them, the last
    three of each. passthrough: nothing of that; one row with the whole text. Null texts have no row.
    """
    every = F.transform(F.split("text", "\r?\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("line")))
    tiered = docs.filter("text IS NOT NULL").select("doc_id", "text", F.filter(every, lambda r: r["line"].rlike(r"\S")).alias("lines"))
    known = F.exists("lines", lambda r: r["line"].rlike(FRAME) | r["line"].rlike(STAMP) | r["line"].rlike(LEVEL))
    tier = F.when(F.try_parse_json(F.get("lines", F.lit(0))["line"]).isNotNull(), "full").when(known, "degraded").otherwise("passthrough")
    tiered = tiered.withColumn("tier", tier)
    of = lambda name: tiered.filter(F.col("tier") == name).select("doc_id", F.lit(name).alias("tier"), F.explode("lines").alias("l")).select("doc_id", "tier", "l.*")
    none = F.lit(None).cast("string")
    is_json = F.try_parse_json("line").isNotNull()
    full = of("full").select("doc_id", "tier", "pos", none.alias("ts"), F.when(is_json, json_level(F.col("line"))).alias("level"), F.coalesce(F.when(is_json, json_text(F.col("line"))), F.trim("line")).alias("message"), F.lit(0).alias("elided"))
    said = entries(_with_frames(of("degraded")), "tier", "frames", "elided")
    message = F.when(F.size("frames") > 0, F.concat_ws("\n", "message", F.array_join("frames", "\n"))).otherwise(F.col("message"))
    degraded = said.select("doc_id", "tier", "pos", "ts", "level", message.alias("message"), "elided")
    passed = tiered.filter("tier = 'passthrough'").select("doc_id", "tier", F.lit(0).alias("pos"), none.alias("ts"), none.alias("level"), F.col("text").alias("message"), F.lit(0).alias("elided"))
    return full.unionByName(degraded).unionByName(passed)


def _with_frames(lines: DataFrame, keep: int = 3) -> DataFrame:
    """Lines (doc_id, tier, pos, line) that are no stack frames, with the last ``keep`` frames that follow each and how many were left
    out. Both windows and the groups lie in one shuffle by document."""
    frame, entry = F.col("line").rlike(FRAME), Window.partitionBy("doc_id", "tier", "entry")
    rows = lines.withColumn("frame", frame).withColumn("entry", F.count_if(~F.col("frame")).over(Window.partitionBy("doc_id").orderBy("pos")))
    rows = rows.withColumn("back", F.row_number().over(entry.orderBy(F.desc("pos"))))
    kept = F.sort_array(F.collect_list(F.when(F.col("frame") & (F.col("back") <= keep), F.struct("pos", F.trim("line").alias("line")))))
    first = F.max(F.when(~F.col("frame"), F.struct("pos", "line")))
    out = rows.groupBy("doc_id", "tier", "entry").agg(first.alias("e"), kept.alias("f"), F.greatest(F.count_if("frame") - keep, F.lit(0)).cast("int").alias("elided"))
    return out.filter("entry > 0").select("doc_id", "tier", "e.pos", "e.line", F.col("f.line").alias("frames"), "elided")


def compress(docs: DataFrame, lossless: bool = False, keep_debug: bool = False) -> DataFrame:
    """doc_id, tier, pos, level, message, count, min_timestamp, max_timestamp: logs with each (level, message) once.

    ``lossless``: what would lose words passes through whole instead: JSON logs, and logs with more than three frames at an
    entry; messages are compared with case and debug lines stay.
    """
    rows = structured(docs)
    if lossless:
        lost = rows.filter((F.col("tier") == "full") | (F.col("elided") > 0)).select("doc_id").distinct()
        none = F.lit(None).cast("string")
        whole = docs.join(lost, "doc_id", "left_semi").select("doc_id", F.lit("passthrough").alias("tier"), F.lit(0).alias("pos"), none.alias("ts"), none.alias("level"), F.col("text").alias("message"), F.lit(0).alias("elided"))
        rows = rows.join(lost, "doc_id", "left_anti").unionByName(whole)
    passed = F.col("tier") == "passthrough"
    merged = deduplicate(rows.filter(~passed), lossless, keep_debug or lossless, "tier")
    none = F.lit(None).cast("string")
    whole = rows.filter(passed).select("doc_id", "tier", "pos", "level", "message", F.lit(1).cast("bigint").alias("count"), none.alias("min_timestamp"), none.alias("max_timestamp"))
    return merged.select("doc_id", "tier", "pos", "level", "message", "count", "min_timestamp", "max_timestamp").unionByName(whole)
