"""Savings analytics: summaries of token-savings records. A row whose compressed text is larger than the raw one stays but saves 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Price of a million input tokens by model tier, in dollars.
TIERS = {"economy": 1.0, "standard": 3.0, "premium": 5.0, "flagship": 15.0}
RETENTION_DAYS = 90


def saved() -> Column:
    return F.greatest(F.col("raw_tokens") - F.col("compressed_tokens"), F.lit(0))


def savings_pct(raw: Column, compressed: Column) -> Column:
    """0 for an empty or an expanded text, else the share saved in percent, in single precision."""
    share = (raw - compressed).cast("float") / F.greatest(raw, F.lit(1)).cast("float") * F.lit(100.0).cast("float")
    return F.when((raw == 0) | (compressed >= raw), F.lit(0.0).cast("float")).otherwise(share.cast("float"))


def since(records: DataFrame, start: int | None) -> DataFrame:
    return records if start is None else records.filter(F.col("timestamp") >= start)


def summary(records: DataFrame, start: int | None = None) -> DataFrame:
    pct = savings_pct(F.col("raw_tokens"), F.col("compressed_tokens"))
    return since(records, start).agg(
        F.count("*").alias("invocations"), F.coalesce(F.sum("raw_tokens"), F.lit(0)).alias("raw_tokens"), F.coalesce(F.sum("compressed_tokens"), F.lit(0)).alias("compressed_tokens"),
        F.coalesce(F.sum(saved()), F.lit(0)).alias("tokens_saved"), F.round(F.coalesce(F.avg(pct.cast("double")), F.lit(0.0)), 4).alias("avg_savings_pct"),
    )


def _measures() -> list[Column]:
    pct = savings_pct(F.col("raw_tokens"), F.col("compressed_tokens")).cast("double")
    return [F.count("*").alias("invocations"), F.sum(saved()).alias("tokens_saved"), F.round(F.avg(pct), 4).alias("avg_savings_pct")]


def daily(records: DataFrame, start: int | None = None) -> DataFrame:
    """By UTC date, newest first."""
    day = F.date_from_unix_date(F.floor(F.col("timestamp") / 86400).cast("int")).cast("string")
    return since(records, start).groupBy(day.alias("day")).agg(*_measures()).orderBy(F.desc("day"))


def by_command(records: DataFrame, start: int | None = None) -> DataFrame:
    out = since(records, start).groupBy("command_type").agg(*_measures(), F.round(F.avg("duration_ms"), 4).alias("avg_duration_ms"))
    return out.orderBy(F.desc("tokens_saved"), "command_type")


def by_language(records: DataFrame, start: int | None = None) -> DataFrame:
    return since(records, start).filter("language IS NOT NULL").groupBy("language").agg(*_measures()).orderBy(F.desc("tokens_saved"), "language")


def by_mode(records: DataFrame, start: int | None = None) -> DataFrame:
    return since(records, start).filter("mode IS NOT NULL").groupBy("mode").agg(*_measures()).orderBy(F.desc("tokens_saved"), "mode")


def tier_distribution(records: DataFrame, start: int | None = None) -> DataFrame:
    """Percent of records by parse tier among those that have one; zeros without any."""
    n = F.greatest(F.count("parse_tier"), F.lit(1))
    share = lambda t: F.round(F.count_if(F.col("parse_tier") == t) * 100.0 / n, 6).alias(f"{t}_pct")
    return since(records, start).agg(share("full"), share("degraded"), share("passthrough"))


def top_commands(records: DataFrame, n: int = 15, start: int | None = None) -> DataFrame:
    return since(records, start).groupBy("original_cmd").agg(*_measures()).orderBy(F.desc("tokens_saved"), "original_cmd").limit(n)


def sessions(records: DataFrame, start: int | None = None) -> DataFrame:
    n = F.count_distinct("session_id")
    tagged = F.coalesce(F.sum(F.when(F.col("session_id").isNotNull(), saved())), F.lit(0))
    return since(records, start).agg(n.alias("sessions"), tagged.alias("tagged_saved"), F.count_if(F.col("session_id").isNull()).alias("untagged"), F.round(tagged / F.greatest(n, F.lit(1)), 6).alias("avg_saved_per_session"))


def weighted_pct(records: DataFrame) -> DataFrame:
    return records.agg(F.round(F.coalesce(F.try_divide(F.sum(saved()) * 100.0, F.sum("raw_tokens")), F.lit(0.0)), 6).alias("weighted_savings_pct"))


def cost_estimate(records: DataFrame) -> DataFrame:
    """Dollars saved at each price tier: one row a tier."""
    total = records.agg(F.coalesce(F.sum(saved()), F.lit(0)).alias("tokens_saved"))
    tiers = F.explode(F.array(*(F.struct(F.lit(k).alias("tier"), F.lit(v).alias("price")) for k, v in TIERS.items()))).alias("t")
    return total.select("tokens_saved", tiers).select("t.tier", "tokens_saved", F.round(F.col("tokens_saved") / 1e6 * F.col("t.price"), 6).alias("dollars"))


def prune(records: DataFrame, now: int, days: int = RETENTION_DAYS) -> DataFrame:
    return records.filter(F.col("timestamp") >= now - days * 86400)


def clean(records: DataFrame) -> DataFrame:
    return records.filter("compressed_tokens <= raw_tokens")


def by_day_and_command(records: DataFrame) -> DataFrame:
    """An extension: a rollup of savings by day and command type."""
    day = F.date_from_unix_date(F.floor(F.col("timestamp") / 86400).cast("int")).cast("string").alias("day")
    return records.select(day, "command_type", saved().alias("s")).rollup("day", "command_type").agg(F.sum("s").alias("tokens_saved"), F.count("*").alias("invocations"))
