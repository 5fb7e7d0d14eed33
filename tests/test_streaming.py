import random

from brindle.plans.rule_queries import QUERIES
from brindle.streaming import jobs


def moves(rows):
    last, out = {}, set()
    for job, seq, status in sorted(rows):
        error = status.lower().startswith("error:")
        if error or last.get(job) != status:
            out.add((job, seq, status))
        if not error:
            last[job] = status
    return out


def run(spark, stream, path, name):
    q = jobs.job_transitions(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(path)).trigger(availableNow=True).start()
    q.awaitTermination()
    return [tuple(r) for r in spark.table(name).collect()]


def test_transitions_of_jobs_longer_than_a_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"j{rng.randrange(3)}", i, rng.choice(["Queued", "Running", "Done", "error: x", "ERROR: y"])) for i in range(400)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "job string, seq bigint, status string").write.parquet(str(tmp_path / "in"))
    most = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(most)
    spark.conf.set(most, "7")
    try:
        got = run(spark, spark.readStream.schema("job string, seq bigint, status string").parquet(str(tmp_path / "in")), tmp_path / "cp", "long_jobs")
    finally:
        spark.conf.set(most, before)
    want = moves(rows)
    assert len(got) == len(want) and set(got) == want


def test_transitions_go_on_from_the_batch_before(spark, tmp_path):
    parts = [[("j", 1, "a"), ("k", 1, "error: x")], [("j", 2, "a"), ("j", 3, "b"), ("k", 2, "a")], [("k", 3, "a"), ("j", 4, "error: z"), ("j", 5, "b")]]
    for part in parts:
        spark.createDataFrame(part, "job string, seq bigint, status string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = run(spark, spark.readStream.schema("job string, seq bigint, status string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), tmp_path / "cp", "later_moves")
    want = moves([r for part in parts for r in part])
    assert len(got) == len(want) and set(got) == want


def test_streams_read_a_table_in_a_folder(spark, tmp_path):
    rows = [(i, i % 3, "ab"[i // 3 % 5 % 2]) for i in range(60)]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string").repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    got = [tuple(r) for r in QUERIES["stream_job_transitions"](spark, str(tmp_path)).collect()]
    want = moves([(str(u), i, t) for i, u, t in rows])
    assert len(got) == len(want) and set(got) == want
