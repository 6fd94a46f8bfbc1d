"""Streams with state: limits over batches, idle keys leave no state, restarts, task rules, the progress log."""

import time
from collections import deque

import pytest
from pyspark.sql import functions as F

from lakesignal.streaming import jobs, stateful

REQUESTS = "key string, ts timestamp"


def add(spark, path, rows, schema, n):
    """One file, newer than those before it, so that it is a batch of its own."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    time.sleep(1.1)


def at(spark, seconds):
    return spark.sql(f"select timestamp_seconds({seconds})").first()[0]


def state_rows(spark, checkpoint, name):
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load().count()


def run(spark, stream, out, checkpoint, mode="append"):
    jobs.run_once(stream, lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/batch={i}"), checkpoint, mode, mode == "append")


def test_refused_requests_do_not_count():
    times = deque()
    out = stateful.allowed(times, [0.0, 1.0, 2.0, 61.0, 61.5], 60, 2)
    assert [ok for _, ok, _ in out] == [True, True, False, True, True] and out[2][2] == 58.0
    assert list(times) == [61.0, 61.5]


def test_limit_goes_on_over_batches_and_a_restart(spark, tmp_path):
    box = lambda rows: [(k, at(spark, s)) for k, s in rows]
    add(spark, f"{tmp_path}/in", box([("a", 1000), ("a", 1001), ("b", 1000), (None, 1000)]), REQUESTS, 0)
    limited = lambda: stateful.rate_limit(jobs.read_table(spark, f"{tmp_path}/in"), 60, 2, "10 seconds")
    run(spark, limited(), f"{tmp_path}/out", f"{tmp_path}/check")
    add(spark, f"{tmp_path}/in", box([("a", 1002), ("a", 1061), ("b", 1030)]), REQUESTS, 1)
    run(spark, limited(), f"{tmp_path}/out", f"{tmp_path}/check")  # the query starts again where it ended
    got = {(r.key, r.at): (r.allowed, r.retry_after) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {
        ("a", 1000.0): (True, 0.0), ("a", 1001.0): (True, 0.0), ("b", 1000.0): (True, 0.0), (None, 1000.0): (True, 0.0),
        ("a", 1002.0): (False, 58.0), ("a", 1061.0): (True, 0.0), ("b", 1030.0): (True, 0.0),
    }


def test_idle_keys_leave_no_state(spark, tmp_path):
    add(spark, f"{tmp_path}/in", [(f"k{i}", at(spark, 1000 + i)) for i in range(30)], REQUESTS, 0)
    add(spark, f"{tmp_path}/in", [("late", at(spark, 5000))], REQUESTS, 1)
    add(spark, f"{tmp_path}/in", [("later", at(spark, 5001))], REQUESTS, 2)
    run(spark, stateful.rate_limit(jobs.read_table(spark, f"{tmp_path}/in"), 60, 2, "10 seconds"), f"{tmp_path}/out", f"{tmp_path}/check")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 32
    assert state_rows(spark, f"{tmp_path}/check", "times") == 2 and state_rows(spark, f"{tmp_path}/check", "due") == 2


def update(seq, status, step=0, stage=None, progress=None, error=None):
    return {"seq": seq, "status": status, "step": step, "stage": stage, "progress": progress, "error": error}


def test_task_rules():
    task = stateful.advance(None, update(1, "queued"))
    assert (task["status"], task["progress"]) == ("queued", 0)
    task = stateful.advance(task, update(2, "processing", 2, "parse", 40))
    task = stateful.advance(task, update(3, "processing", 3, "embed", 20))
    assert (task["status"], task["step"], task["stage"], task["progress"]) == ("processing", 3, "embed", 40)  # progress never falls
    assert stateful.advance(task, update(4, "processing", 3, "embed", 250))["progress"] == 99
    failed = stateful.advance(task, update(5, "failed", error="disk"))
    assert (failed["status"], failed["stage"], failed["progress"], failed["error"]) == ("failed", "embed", 40, "disk")
    assert stateful.advance(failed, update(6, "processing", 4, "x", 80)) == failed  # an end stays
    done = stateful.advance(failed, update(7, "completed"))
    assert done == {"seq": 7, "status": "completed", "step": 5, "stage": "Complete", "progress": 100, "error": None}
    assert stateful.advance(done, update(8, "queued")) == done


UPDATES = "task_id string, seq long, status string, step int, stage string, progress int, error string"


def test_task_stream_over_batches_with_a_progress_log(spark, tmp_path):
    rows = lambda *u: [("t", *x) for x in u]
    add(spark, f"{tmp_path}/in", rows((2, "processing", 2, "parse", 40, None), (1, "queued", 0, None, None, None)), UPDATES, 0)
    add(spark, f"{tmp_path}/in", rows((4, "processing", 3, "embed", 10, None), (3, "failed", 0, "parse", None, "disk")) + [("u", 1, "processing", 1, "a", 5, None)], UPDATES, 1)
    listener = stateful.ProgressLog(spark, f"{tmp_path}/log")
    spark.streams.addListener(listener)
    try:
        run(spark, stateful.task_states(jobs.read_table(spark, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/check", "update")
        for _ in range(50):  # events come some time after the batches
            if any((tmp_path / "log").glob("*-end.json")):
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    got = {(r.batch, r.task_id): (r.status, r.step, r.stage, r.progress, r.error) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {
        (0, "t"): ("processing", 2, "parse", 40, None),
        (1, "t"): ("failed", 2, "parse", 40, "disk"),
        (1, "u"): ("processing", 1, "a", 5, None),
    }
    log = spark.read.json(f"{tmp_path}/log")
    assert {r.event for r in log.select("event").collect()} == {"started", "progress", "ended"}
    assert log.where("event = 'progress'").agg(F.sum("rows")).first()[0] == 5


def test_states_of_old_tasks_end(spark, tmp_path):
    add(spark, f"{tmp_path}/in", [("t", 1, "completed", 0, None, None, None)], UPDATES, 0)
    stream = lambda: stateful.task_states(jobs.read_table(spark, f"{tmp_path}/in"), ttl_ms=500)
    run(spark, stream(), f"{tmp_path}/out", f"{tmp_path}/check", "update")
    add(spark, f"{tmp_path}/in", [("t", 2, "processing", 1, "again", 7, None)], UPDATES, 1)
    run(spark, stream(), f"{tmp_path}/out", f"{tmp_path}/check", "update")
    assert [r.status for r in spark.read.parquet(f"{tmp_path}/out").where("batch = 1").collect()] == ["processing"]
