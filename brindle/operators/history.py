"""History analytics over commits (hash, ts, author, message, is_fix) and touches (one row a changed file of a commit).

Every metric is one or two hash aggregations on the path or the commit; scalars are one-row aggregates, broadcast. No
window spans files or commits as a whole. Ties are broken by path, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.parsers import is_excluded
from brindle.operators.numbering import number_rows

DECAY_DAYS = 30.0  # an e-folding time
PAIR_LIMIT = 50  # commits with more files make no pairs
MIN_SUPPORT = 3
FIX_WINDOW = 5
COUPLING_THRESHOLD = 0.5
LEAST_WEIGHT = 2.0**-52  # a file whose decayed touches weigh no more has no fix density
FIX_WORDS = r"(?i)\b(fix|bug|hotfix|patch|revert)\b"


def is_fix(message: Column) -> Column:
    return F.coalesce(message.rlike(FIX_WORDS), F.lit(False))


def age_days(ts: Column, now: int) -> Column:
    return F.greatest(F.lit(now) - F.greatest(ts, F.lit(0)), F.lit(0)) / 86400.0


def decay(ts: Column, now: int, days: float = DECAY_DAYS) -> Column:
    return F.exp(-age_days(ts, now) / days)


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """The columns of a one-row table beside every row; a broadcast join on a constant."""
    return df.withColumn("__k", F.lit(1)).join(F.broadcast(one_row.withColumn("__k", F.lit(1))), "__k").drop("__k")


def with_total(df: DataFrame, commits: DataFrame, name: str = "total_commits") -> DataFrame:
    """The number of commits as a column."""
    return with_scalars(df, commits.agg(F.count("*").alias(name)))


def commit_index(commits: DataFrame) -> DataFrame:
    """commit_idx, 0 for the newest; equal times by hash."""
    return number_rows(commits, [-F.col("ts"), F.col("hash")], "commit_idx")


def without_excluded(touches: DataFrame, commits: DataFrame, extra: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(touches, commits) without generated and vendored paths and further globs; commits that are left without a file go."""
    kept = touches.filter(~is_excluded(F.col("path"), extra))
    return kept, commits.join(kept.select("hash"), "hash", "left_semi")


def churn(touches: DataFrame, commits: DataFrame) -> DataFrame:
    counts = touches.groupBy("path").agg(F.count("*").alias("touches"))
    return with_total(counts, commits).select("path", "touches", F.round(F.col("touches") / F.col("total_commits"), 9).alias("churn_rate"))


def file_risk(touches: DataFrame, now: int) -> DataFrame:
    """Decayed hotspot score over its maximum, and the decayed share of fixes. A path listed twice in a commit counts twice."""
    weight = decay(F.col("ts"), now)
    raw = touches.groupBy("path").agg(F.sum(weight).alias("raw"), F.coalesce(F.sum(F.when(F.col("is_fix"), weight)), F.lit(0.0)).alias("fixed"), F.count("*").alias("total"), F.count_if("is_fix").alias("fixes"))
    rows = with_scalars(raw, raw.agg(F.max("raw").alias("top")))
    score = F.when(F.col("top") > 0, F.col("raw") / F.col("top")).otherwise(0.0)
    density = F.when(F.col("raw") > LEAST_WEIGHT, F.col("fixed") / F.col("raw")).otherwise(0.0)
    return rows.select("path", F.round(score, 6).alias("score"), "total", "fixes", F.round(density, 6).alias("fix_density"), F.round(score * density, 6).alias("risk_score"))


def temporal_stats(touches: DataFrame, now: int) -> DataFrame:
    """Distinct (commit, file) counts: all, fixes, within 30 and 90 days inclusive; a future commit is 0 days old."""
    once = touches.select("hash", "path", "ts", "is_fix").dropDuplicates(["hash", "path"])
    days = age_days(F.col("ts"), now)
    return once.groupBy("path").agg(F.count("*").alias("commits"), F.count_if("is_fix").alias("fixes"), F.count_if(days <= 30).alias("changes_30d"), F.count_if(days <= 90).alias("changes_90d"))


def small_commits(touches: DataFrame, limit: int = PAIR_LIMIT, least: int = 1) -> DataFrame:
    """Distinct (hash, path) of commits with ``least`` to ``limit`` listed files, counted before duplicates go."""
    size = touches.groupBy("hash").agg(F.count("*").alias("n")).filter(F.col("n").between(least, limit))
    return touches.select("hash", "path").distinct().join(size, "hash")


def similarity(both: Column, a: Column, b: Column) -> Column:
    """Jaccard similarity of two files by the commits of both and of each."""
    return F.round(both / (a + b - both), 6)


def cochange(touches: DataFrame, limit: int = PAIR_LIMIT) -> DataFrame:
    """file_a < file_b, count, jaccard. A commit makes at most limit * (limit - 1) / 2 pairs, so rows stay linear in commits."""
    files = small_commits(touches, limit).select("hash", "path")
    a, b = files.withColumnRenamed("path", "file_a"), files.withColumnRenamed("path", "file_b")
    pairs = a.join(b, "hash").filter("file_a < file_b").groupBy("file_a", "file_b").agg(F.count("*").alias("count"))
    n = files.groupBy("path").agg(F.count("*").alias("n"))
    out = pairs.join(n.select(F.col("path").alias("file_a"), F.col("n").alias("n_a")), "file_a").join(n.select(F.col("path").alias("file_b"), F.col("n").alias("n_b")), "file_b")
    return out.select("file_a", "file_b", "count", similarity(F.col("count"), F.col("n_a"), F.col("n_b")).alias("jaccard"))


def partners(pairs: DataFrame, path: str, least: float = 0.10, limit: int = 10_000) -> DataFrame:
    """The other side of a file's pairs, the most similar first."""
    hits = pairs.filter(((F.col("file_a") == path) | (F.col("file_b") == path)) & (F.col("jaccard") >= least))
    other = F.when(F.col("file_a") == path, F.col("file_b")).otherwise(F.col("file_a"))
    return hits.select(other.alias("partner"), "count", "jaccard").orderBy(F.desc("jaccard"), "partner").limit(limit)


def blast_radius(touches: DataFrame, threshold: float = COUPLING_THRESHOLD, support: int = MIN_SUPPORT, limit: int = PAIR_LIMIT) -> DataFrame:
    """path, other, confidence, support: how much of a file's weight it shares with another one.

    A commit gives each file it lists 1/sqrt(files), duplicates kept. Every commit adds to a file's own weight, commits of
    one file and of more than ``limit`` too; only commits of 2 to ``limit`` files make pairs.
    """
    size = touches.groupBy("hash").agg(F.count("*").alias("n"))
    rows = touches.select("hash", "path").join(size, "hash").withColumn("w", 1 / F.sqrt("n"))
    own = rows.groupBy("path").agg(F.sum("w").alias("own"))
    small = rows.filter(F.col("n").between(2, limit))
    other = small.select("hash", F.col("path").alias("other"))
    both = small.join(other, "hash").filter("path <> other").groupBy("path", "other").agg(F.sum("w").alias("shared"), F.count("*").alias("support"))
    found = both.filter(F.col("support") >= support).join(own, "path").withColumn("confidence", F.col("shared") / F.col("own"))
    return found.filter(F.col("confidence") >= threshold).select("path", "other", F.round("confidence", 6).alias("confidence"), "support")


def coupling(radius: DataFrame) -> DataFrame:
    """Undirected edges (file_a, file_b, confidence, support) of a blast radius, with the higher confidence of both directions."""
    edges = radius.groupBy(F.least("path", "other").alias("file_a"), F.greatest("path", "other").alias("file_b"))
    return edges.agg(F.max("confidence").alias("confidence"), F.max("support").alias("support"))


def _stability(touched: Column, top: Column, last: Column, fixes: Column, now: int) -> Column:
    loss = 40 * F.least(touched / F.greatest(top, F.lit(1)), F.lit(1.0)) + 35 * decay(last, now) + 25 * fixes / touched
    return F.greatest(F.lit(0), F.least(F.lit(100), F.round(100 - loss))).cast("int")


def stability(touches: DataFrame, now: int) -> DataFrame:
    """100 less 40 parts churn, 35 recency and 25 fixes, rounded half up and clamped."""
    f = touches.groupBy("path").agg(F.count("*").alias("touches"), F.max("ts").alias("last"), F.count_if("is_fix").alias("fixes"))
    rows = with_scalars(f, f.agg(F.max("touches").alias("top")))
    return rows.select("path", _stability(F.col("touches"), F.col("top"), F.col("last"), F.col("fixes"), now).alias("stability"))


def authors(touches: DataFrame) -> DataFrame:
    """Share of the leading author in percent, whether that is over 80, and authors with at least 5 percent (rounded up)."""
    each = touches.groupBy("path", "author").agg(F.count("*").alias("k"))
    total = F.sum("k").over(Window.partitionBy("path"))
    each = each.withColumn("total", total)
    share = F.max("k") * 100.0 / F.max("total")
    return each.groupBy("path").agg(F.round(share, 6).alias("top_author_pct"), (share > 80).alias("single_owner"), F.count_if(F.col("k") >= F.ceil(F.col("total") * 0.05)).alias("authors"))


def _risky_touches(touches: DataFrame, commits: DataFrame, window: int) -> DataFrame:
    """``touches`` with risky: no fix itself, but a fix of the file follows within the next ``window`` commit indices.

    Indices are cut into buckets of ``window``: the next fix lies in a touch's own bucket or is the first of the following one,
    so no file, however often touched, is sorted in one task.
    """
    order = commit_index(commits).select("hash", "commit_idx")
    rows = touches.join(order, "hash").withColumn("bucket", F.floor(F.col("commit_idx") / window))
    first = rows.filter("is_fix").groupBy("path", (F.col("bucket") - 1).alias("bucket")).agg(F.min("commit_idx").alias("next"))
    ahead = Window.partitionBy("path", "bucket").orderBy("commit_idx").rangeBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("inside", F.max("is_fix").over(ahead)).join(first, ["path", "bucket"], "left")
    follows = F.coalesce("inside", F.lit(False)) | F.coalesce(F.col("next") - F.col("commit_idx") <= window, F.lit(False))
    return rows.withColumn("risky", ~F.col("is_fix") & follows).drop("bucket", "inside", "next", "commit_idx")


def _fix_shares() -> list[Column]:
    """keyword_pct, proximity_pct, combined_pct, insufficient of grouped touches; under 2 touches all shares are 0."""
    pct = lambda c: F.when(F.count("*") < 2, 0.0).otherwise(F.round(F.count_if(c) * 100.0 / F.count("*"), 6))
    return [pct(F.col("is_fix")).alias("keyword_pct"), pct(F.col("risky")).alias("proximity_pct"), pct(F.col("is_fix") | F.col("risky")).alias("combined_pct"), (F.count("*") < 2).alias("insufficient")]


def fix_after_touch(touches: DataFrame, commits: DataFrame, window: int = FIX_WINDOW) -> DataFrame:
    """Percent of touches that are fixes, of plain touches with a fix of the file within the next ``window`` commit indices
    (index 0 is the newest, so these are older commits), and of both together. Shares are of all touches; under 2
    touches is too few, and all are 0."""
    return _risky_touches(touches, commits, window).groupBy("path").agg(F.count("*").alias("touches"), *_fix_shares())


def module_of(path: Column) -> Column:
    """The top folder; null for files that lie in none."""
    return F.when(path.contains("/"), F.substring_index(path, "/", 1))


def encapsulation(touches: DataFrame, least: int = 3) -> DataFrame:
    """Per top directory: commits, those that also touch another one, distinct files, and the percent that stay inside.

    Files without a folder belong to no module and make no commit cross a boundary.
    """
    rows = touches.select("hash", "path", module_of(F.col("path")).alias("module")).filter("module IS NOT NULL")
    per = rows.select("hash", "module").distinct()
    wide = per.groupBy("hash").agg((F.count("*") > 1).alias("cross"))
    m = per.join(wide, "hash").groupBy("module").agg(F.count("*").alias("commits"), F.count_if("cross").alias("cross_commits"))
    files = rows.select("module", "path").distinct().groupBy("module").agg(F.count("*").alias("files"))
    pct = F.round((F.col("commits") - F.col("cross_commits")) * 100.0 / F.col("commits"), 6)
    return m.join(files, "module").filter(F.col("commits") >= least).select("module", "commits", "cross_commits", "files", pct.alias("encapsulation_pct")).orderBy("encapsulation_pct", "module")


def heatmap(touches: DataFrame, commits: DataFrame, now: int, radius: DataFrame | None = None) -> DataFrame:
    """One row a file: churn, stability, authors, fix shares and the number of coupled files, the least stable first.

    All but authors and coupling come from one aggregation by path. Give touches as a stored table, since several parts read it.
    """
    rows = _risky_touches(touches.select("hash", "path", "ts", "is_fix"), commits, FIX_WINDOW)
    base = rows.groupBy("path").agg(F.count("*").alias("touches"), F.max("ts").alias("last"), F.count_if("is_fix").alias("fixes"), *_fix_shares())
    scalars = touches.groupBy("path").agg(F.count("*").alias("k")).agg(F.max("k").alias("top"))
    base = with_total(with_scalars(base, scalars), commits)
    base = base.withColumn("churn_rate", F.round(F.col("touches") / F.col("total_commits"), 9)).withColumn("stability", _stability(F.col("touches"), F.col("top"), F.col("last"), F.col("fixes"), now))
    n = (blast_radius(touches) if radius is None else radius).groupBy("path").agg(F.count("*").alias("coupled"))
    out = base.drop("last", "fixes", "top", "total_commits").join(authors(touches), "path", "left").join(n, "path", "left")
    return out.fillna({"coupled": 0}).orderBy("stability", "path")


def insights(metrics: DataFrame, modules: DataFrame, radius: DataFrame) -> DataFrame:
    """kind, subject, detail, value, severity of five rules, critical ones first, then how bad the value is.

    Coupling speaks once for a file and each partner (detail) above 0.8.
    """

    def rule(df, kind, subject, value, critical, warning, detail=F.lit(None).cast("string")):
        level = F.when(critical, F.lit("critical")).when(warning, F.lit("warning"))
        return df.select(F.lit(kind).alias("kind"), subject.alias("subject"), detail.alias("detail"), F.round(value.cast("double"), 6).alias("value"), level.alias("severity")).filter("severity IS NOT NULL")

    c, no = F.col, F.lit(False)
    rows = [
        rule(metrics, "stability", c("path"), c("stability"), c("stability") < 40, c("stability") < 70),
        rule(metrics.filter("NOT insufficient"), "fix_risk", c("path"), c("combined_pct"), c("combined_pct") > 50, c("combined_pct") > 30),
        rule(modules, "encapsulation", c("module"), c("encapsulation_pct"), c("encapsulation_pct") < 40, c("encapsulation_pct") < 60),
        rule(radius, "coupling", c("path"), c("confidence"), no, c("confidence") > 0.8, c("other")),
        rule(metrics, "single_owner", c("path"), c("top_author_pct"), no, c("top_author_pct") > 80),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    badness = F.when(F.col("kind").isin("stability", "encapsulation"), 100 - F.col("value")).otherwise(F.col("value"))
    return out.orderBy("severity", F.desc(badness), "kind", "subject", "detail")


def top(df: DataFrame, score: str, n: int = 20, ascending: bool = False, key: str = "path") -> DataFrame:
    """Hotspots, coldspots or risks: a bounded heap in each task, never a full sort."""
    return df.orderBy(F.asc(score) if ascending else F.desc(score), key).limit(n)


def scope(df: DataFrame, targets: DataFrame, key: str = "path") -> DataFrame:
    return df.join(targets.select(F.col("path").alias(key)), key, "left_semi")


def missing(targets: DataFrame, touches: DataFrame) -> DataFrame:
    """Targets that history does not know."""
    return targets.join(touches.select("path"), "path", "left_anti")


def resolve_partners(found: DataFrame, files: DataFrame) -> DataFrame:
    """file_id, partner, count, jaccard of partners that are among indexed files (path, file_id); others go."""
    return found.join(files.select(F.col("path").alias("partner"), "file_id"), "partner").select("file_id", "partner", "count", "jaccard")


def resort_partners(found: DataFrame, scores: DataFrame, limit: int = 20) -> DataFrame:
    """The max(5 * limit, 100) most similar partners ordered by their own score (missing: 0), similarity next."""
    first = found.orderBy(F.desc("jaccard"), "partner").limit(max(5 * limit, 100))
    joined = first.join(scores.select(F.col("path").alias("partner"), "score"), "partner", "left").fillna({"score": 0.0})
    return joined.orderBy(F.desc("score"), F.desc("jaccard"), "partner").limit(limit)


def annotate(results: DataFrame, scores: DataFrame, mode: str = "hot") -> DataFrame:
    """Results with the history score of their path (missing: -1), in the order of the mode."""
    col = "risk_score" if mode == "risky" else "score"
    out = results.join(scores.select("path", F.col(col).alias("history_score")), "path", "left").fillna({"history_score": -1.0})
    orders = {"hot": [F.desc("history_score"), F.desc("path")], "cold": [F.asc("history_score"), F.asc("path")], "risky": [F.desc("history_score"), F.asc("path")]}
    return out.orderBy(*orders[mode])


# Days of the named windows; "all" begins in 1970.
PRESETS = {"sprint": 14, "month": 30, "quarter": 90, "half": 180, "year": 365}


def _nth_newest(commits: DataFrame, count: int) -> Column:
    """The time of the count-th newest commit, if there are that many and it lies after 1970; an aggregate over the newest."""
    return F.when((F.count("*") == count) & (F.min("ts") > 0), F.min("ts")).cast("bigint")


def window_start(commits: DataFrame, now: int, days: int = 90, count: int = 200, since: int | None = None, last: int | None = None, preset: str | None = None) -> DataFrame:
    """since, nth, warning: where the window of analysis begins (null: no bound).

    ``since`` goes before ``last`` (the time of the last-th newest commit), that before ``preset``; without any, the earlier
    of now - days and the time of the count-th newest commit. Unknown presets and too few commits bound nothing and
    warn, more than one setting warns.
    """
    given = sum(x is not None for x in (since, last, preset))
    warning = F.lit("several windows" if given > 1 else None).cast("string")
    number = last if since is None and last is not None else count
    newest = commits.orderBy(F.desc("ts"), "hash").limit(number)
    row = newest.agg(_nth_newest(newest, number).alias("nth"))
    none = F.lit(None).cast("bigint")
    if since is not None:
        return row.select(F.lit(since).cast("bigint").alias("since"), none.alias("nth"), warning.alias("warning"))
    if last is not None:
        return row.select(F.col("nth").alias("since"), "nth", F.when(F.col("nth").isNull(), "too few commits").otherwise(warning).alias("warning"))
    if preset is not None:
        start = 0 if preset == "all" else now - PRESETS[preset] * 86400 if preset in PRESETS else None
        return row.select(F.lit(start).cast("bigint").alias("since"), none.alias("nth"), (F.lit("unknown window") if start is None else warning).alias("warning"))
    start = F.lit(now - days * 86400)
    return row.select(F.least(start, F.coalesce("nth", start)).cast("bigint").alias("since"), "nth", warning.alias("warning"))


def split(commits: DataFrame, fraction: float = 0.8) -> DataFrame:
    """train for the oldest floor(n * fraction) commits (at least one, at most all but one)."""
    f = 0.8 if fraction != fraction else min(max(fraction, 0.01), 0.99)
    rows = with_total(number_rows(commits.select("hash", "ts"), [F.col("ts"), F.col("hash")], "rn"), commits, "n")
    cut = F.greatest(F.lit(1), F.least(F.col("n") - 1, F.floor(F.col("n") * f)))
    return rows.select("hash", (F.col("rn") < cut).alias("train"))


def quality_gate(touches: DataFrame, commits: DataFrame, least: int = 50, days: int = 180) -> DataFrame:
    multi = touches.groupBy("hash").agg(F.count_distinct("path").alias("n")).agg(F.count_if(F.col("n") >= 2).alias("multi"))
    span = commits.agg(((F.max("ts") - F.min("ts")) / 86400.0).alias("span_days"), F.count("*").alias("n"))
    both = multi.withColumn("k", F.lit(1)).join(span.withColumn("k", F.lit(1)), "k")
    return both.select("multi", F.round("span_days", 6).alias("span_days"), ((F.col("multi") >= least) & ((F.col("n") < 2) | (F.col("span_days") >= days))).alias("passed"))


def dense_ids(paths: DataFrame) -> DataFrame:
    """Sorted distinct paths numbered from 0."""
    return number_rows(paths.select("path").distinct(), [F.col("path")], "file_id")
