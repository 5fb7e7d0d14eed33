"""Retrieval evaluation: ranked (query, doc_id, rank) against qrels (query, doc_id)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.history import PAIR_LIMIT, similarity, with_scalars
from brindle.operators.numbering import number_rows
from brindle.sources import scratch

#: Touches of a file for each of its slices, pairs of one task, about, the most tasks of a round, and rounds of files, whose shuffle
#: files don't lie on disk together. None bounds the rows.
SLICE, TASK_PAIRS, MOST_TASKS, ROUNDS = 100_000, 1_000_000, 4096, 4


def first_hits(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """query, rank of the first relevant document; null without one."""
    hits = ranked.join(qrels.select("query", "doc_id"), ["query", "doc_id"]).groupBy("query").agg(F.min("rank").alias("rank"))
    return qrels.select("query").distinct().join(hits, "query", "left")


def ranking_metrics(ranked: DataFrame, qrels: DataFrame, ks=(5, 10)) -> DataFrame:
    """Mean reciprocal rank, precision at each k (over k even with fewer results) and first ranks, over all queries."""
    first = first_hits(ranked, qrels).agg(F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"), F.count_if(F.col("rank") == 1).alias("rank_1"), F.count("*").alias("queries"))
    hits = ranked.join(qrels.select("query", "doc_id"), ["query", "doc_id"])
    at = hits.agg(*(F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in ks))
    out = first.withColumn("k", F.lit(1)).join(at.withColumn("k", F.lit(1)), "k")
    return out.select("mrr", "rank_1", "queries", *(F.round(F.col(f"h{k}") / k / F.col("queries"), 6).alias(f"p_at_{k}") for k in ks))


def harmonic(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def predict_cochange(touches: DataFrame, thresholds=(0.1, 0.3, 0.5), most: int = 500, limit: int = PAIR_LIMIT) -> DataFrame:
    """threshold, commits, micro and macro precision, recall, f1 of co-change predictions for the files of test commits.

    touches: hash, path, train (one value a commit). Predictions are the pairs that ``cochange`` finds in train commits; files
    without a train commit are left out. Every file of a test commit with 2 to ``most`` files asks for its partners; the others
    of its commit are right. Macro is the mean over commits of the mean over their files; f1 follows from the means.

    A file's predictions are the same in every commit that asks, so no row is made for each of them: every measure is a sum over
    ordered pairs of files of what the test commits with both weigh. A file gets the lists of its commits, and pairs are
    counted where they arrive; a file with more than SLICE touches is dealt to several tasks by the other file.
    """
    listed = F.sum("m").over(Window.partitionBy("hash"))
    once = touches.groupBy("hash", "path").agg(F.count("*").alias("m"), F.max("train").alias("train")).withColumn("small", listed <= limit)
    once = scratch.written(once.select("hash", "path", "train", "small"), "touches")
    kind = "int" if once.count() < 1 << 30 else "bigint"
    of = once.groupBy("path").agg(F.max("train").alias("known"), F.count_if(F.col("train") & F.col("small")).alias("n"), F.count("*").alias("all"))
    known = scratch.written(of.filter("known").select("path", F.col("n").cast(kind), (F.floor(F.col("all") / SLICE) + 1).cast(kind).alias("parts")), "files")
    ids = number_rows(known, [F.col("path")], "id").withColumn("id", F.col("id").cast(kind))
    files = scratch.written(once.filter("small OR NOT train").join(ids, "path").select("hash", "train", "id", "n", "parts"), "numbered")
    scratch.release(once, known)
    size = F.count("*").over(Window.partitionBy("hash", "train")).cast("int")
    asked = files.withColumn("k", size).filter((F.col("k") >= 2) & (F.col("train") | (F.col("k") <= most))).withColumn("k", F.when(~F.col("train"), F.col("k")).otherwise(0))
    commits = scratch.written(asked.groupBy("hash", "train").agg(F.max("k").alias("k"), F.collect_list(F.struct("id", "n", "parts")).alias("files")).select("k", "files"), "commits")
    scratch.release(files)
    pairs = commits.agg(F.sum(F.size("files").cast("bigint") * F.size("files"))).first()[0] or 0

    rounds = ROUNDS if pairs > ROUNDS * TASK_PAIRS else 1
    tasks = min(MOST_TASKS, pairs // rounds // TASK_PAIRS + 1)
    sums = [scratch.written(_pair_sums(commits, F.pmod("f.id", F.lit(rounds)) == i, thresholds, tasks, kind), "sums") for i in range(rounds)]
    total = reduce(DataFrame.unionByName, sums).groupBy("threshold").agg(*(F.sum(c).alias(c) for c in ("h", "p", "mp", "mr")))
    none = lambda c: F.coalesce(c, F.lit(0.0))
    over = commits.filter("k > 0").agg(F.count("*").alias("commits"), F.sum(F.col("k").cast("bigint") * (F.col("k") - 1)).alias("a"))
    out = with_scalars(total, over).filter("commits > 0")
    out = out.select("threshold", "commits", none(F.try_divide("h", "p")).alias("up"), none(F.col("h") / F.col("a")).alias("ur"), none(F.col("mp") / F.col("commits")).alias("mp"), none(F.col("mr") / F.col("commits")).alias("mr"))
    r = lambda c, n: F.round(c, 6).alias(n)
    return out.select("threshold", "commits", r(F.col("up"), "micro_precision"), r(F.col("ur"), "micro_recall"), r(harmonic(F.col("up"), F.col("ur")), "micro_f1"), r(F.col("mp"), "macro_precision"), r(F.col("mr"), "macro_recall"), r(harmonic(F.col("mp"), F.col("mr")), "macro_f1"))


def _pair_sums(commits: DataFrame, chosen: Column, thresholds, tasks: int, kind: str) -> DataFrame:
    """threshold, h (right predictions), p (predictions), mp and mr (sums of the commits' means) of the ``chosen`` files f of commits
    (k: files of a test commit, 0 for train; files: id, n, parts)."""
    sent = commits.select("k", F.explode("files").alias("f"), F.col("files.id").alias("ids"), F.col("files.n").alias("ns"), "files").filter(chosen)
    part = lambda x, s: F.pmod(x["id"], F.col("f.parts")) == s
    cut = lambda s: F.struct(s.alias("s"), F.transform(F.filter("files", lambda x: part(x, s)), lambda x: x["id"]).alias("ids"), F.transform(F.filter("files", lambda x: part(x, s)), lambda x: x["n"]).alias("ns"))
    parts = F.when(F.col("f.parts") == 1, F.array(F.struct(F.lit(0).cast(kind).alias("s"), "ids", "ns"))).otherwise(F.transform(F.array_distinct(F.transform("files", lambda x: F.pmod(x["id"], F.col("f.parts")))), cut))
    sent = sent.select("k", F.col("f.id").alias("id"), F.col("f.n").alias("n"), F.explode(parts).alias("o")).select("id", "n", "k", "o.s", "o.ids", "o.ns")
    dealt = sent.repartition(tasks, "id", "s")
    met = dealt.select("id", "s", "n", "k", "ns", F.posexplode("ids").alias("at", "other")).select("id", "s", "n", "k", "other", F.get("ns", "at").alias("n_other"))
    k, test = F.col("k"), F.col("k") > 0
    met = met.groupBy("id", "s", "other").agg(
        F.max("n").alias("n"), F.max("n_other").alias("n_other"), F.count_if(~test).alias("c"), F.count_if(test).alias("h"),
        F.sum(F.when(test, 1 / k).otherwise(0.0)).alias("w"), F.sum(F.when(test, 1 / k / (k - 1)).otherwise(0.0)).alias("v"),
    )
    own = F.col("id") == F.col("other")
    met = met.select("id", F.when(own, F.col("h")).alias("asks"), "h", "w", "v", F.when(~own & (F.col("c") > 0), similarity(F.col("c"), F.col("n"), F.col("n_other"))).alias("j"))
    sums = [c for i, t in enumerate(thresholds) for c in (F.count_if(F.col("j") >= t).alias(f"p{i}"), *(F.sum(F.when(F.col("j") >= t, F.col(x))).alias(f"{x}{i}") for x in "hwv"))]
    each = met.groupBy("id").agg(F.sum("asks").alias("asks"), *sums).filter("asks > 0")
    rows = each.select("asks", F.explode(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), *(F.col(f"{x}{i}").alias(x) for x in "phwv")) for i, t in enumerate(thresholds)))).alias("r")).select("asks", "r.*")
    return rows.groupBy("threshold").agg(F.sum("h").alias("h"), F.sum(F.col("p") * F.col("asks")).alias("p"), F.sum(F.try_divide("w", "p")).alias("mp"), F.sum("v").alias("mr"))


def hash_split(query: Column) -> Column:
    """train for three fifths of queries, by the first byte of their SHA-256."""
    return F.when(F.conv(F.substring(F.sha2(query.cast("binary"), 256), 1, 2), 16, 10).cast("int") % 5 < 3, "train").otherwise("test")


def coordinate_descent(evaluate, start: dict[str, float], candidates: dict[str, list[float]], passes: int = 3, least: float = 0.001) -> tuple[dict[str, float], float]:
    """Tune one parameter after another; ``evaluate`` gives the MRR of a setting. A pass that gains under ``least`` is the last."""
    best, top = dict(start), evaluate(start)
    for _ in range(passes):
        before = top
        for name, values in candidates.items():
            for v in values:
                trial = best | {name: v}
                if trial != best and (score := evaluate(trial)) > top:
                    best, top = trial, score
        if top - before < least:
            break
    return best, top


# Judgements wanted by field, and bounds on names.
QUOTAS = {"type_definition": 15, "function_signature": 15, "import_export": 10, "symbol_name": 10}
MAX_NAME_FILES, MIN_NAME_BYTES = 5, 4


def generate_qrels(symbols: DataFrame) -> DataFrame:
    """query, relevant_doc, field of symbols (doc_id, pos, name, field): names of four bytes or more with a letter, in five documents at
    most; a name's first place counts, and each field gives its first names up to its quota."""
    rows = symbols.filter((F.octet_length("name") >= MIN_NAME_BYTES) & F.col("name").rlike(r"\p{L}"))
    first = rows.groupBy("name").agg(F.min(F.struct("doc_id", "pos", "field")).alias("f"), F.count_distinct("doc_id").alias("df")).filter(F.col("df") <= MAX_NAME_FILES)
    found = first.select(F.col("name").alias("query"), F.col("f.doc_id").alias("relevant_doc"), "f.pos", "f.field")
    tops = [found.filter(F.col("field") == field).orderBy("relevant_doc", "pos").limit(n) for field, n in QUOTAS.items()]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out.select("query", "relevant_doc", "field")
