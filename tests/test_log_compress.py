import hashlib
import json

from brindle.functions import logs as lg
from brindle.plans.rule_queries import QUERIES


def test_long_json_messages_stay_whole(spark):
    long = "x" * 16_384
    lines = [{"level": "info", "msg": long + " one"}, {"level": "info", "msg": long + " two"}, {"lvl": "info", "text": long.upper() + " ONE"}, {"severity": "warn", "body": long * 3}]
    df = spark.createDataFrame([(1, "\n".join(map(json.dumps, lines)))], "doc_id int, text string")
    got = [(r.pos, r.level, r.message, r["count"]) for r in lg.compress(df).orderBy("pos").collect()]
    assert got == [(0, "INFO", long + " one", 2), (1, "INFO", long + " two", 1), (3, "WARN", long * 3, 1)]


def test_query_hashes_whole_messages(spark, tmp_path):
    texts = {3: "a\n" + "word " * 5_000 + "end", 6: "y" * 16_385}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.pos, r.message) for r in QUERIES["log_compress"](spark, str(tmp_path)).collect()}
    assert got == {(d, i, hashlib.md5(x.encode()).hexdigest()) for d, t in texts.items() for i, x in enumerate(t.split("\n"))}


def test_lines_of_a_log_are_shuffled_once(spark):
    texts = ['{"msg":"a"}\nb', "ERROR: x\n  at 1\n  at 2\n  at 3\n  at 4\nWARN: y\n at 5", "plain", "  at 1\nfoo", "\n \n", "[info] z", "[]\n", "2024-01-02 03:04:05 w"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = lg.structured(df)
    got = sorted((r.doc_id, r.tier, r.pos, r.ts, r.level, r.message, r.elided) for r in out.collect())
    assert got == [
        (0, "full", 0, None, None, "a", 0), (0, "full", 1, None, None, "b", 0),
        (1, "degraded", 0, None, "ERROR", "x\nat 2\nat 3\nat 4", 1), (1, "degraded", 5, None, "WARN", "y\nat 5", 0),
        (2, "passthrough", 0, None, None, "plain", 0), (3, "degraded", 1, None, None, "foo", 0),
        (4, "passthrough", 0, None, None, "\n \n", 0), (5, "degraded", 0, None, "INFO", "z", 0),
        (6, "full", 0, None, None, "[]", 0), (7, "degraded", 0, "2024-01-02 03:04:05", None, "w", 0),
    ]
    plan = lg.structured(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
