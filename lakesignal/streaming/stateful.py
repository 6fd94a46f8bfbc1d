"""Streams with state of their own: request limits and task states, kept by key with timers and time to live, and progress logs.

State lives in RocksDB, so it is bounded by disk, not by memory; use_rocksdb sets it
for the streams that a session starts next.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

RATE_SECONDS, RATE_MOST = 60, 20
#: A finished task's state is kept so long for late updates, then forgotten; the sink keeps its rows.
TASK_TTL_MS = 24 * 3600 * 1000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def allowed(times: deque, new: list[float], window: float, most: int) -> list[tuple[float, bool, float]]:
    """Sliding-window limit: (time, allowed, retry after) of each new time; times keeps the allowed ones that still count.

    A request counts while it is less than a window old; refused ones never
    count. A time drops out once, so a request costs constant time whatever the limit.
    """
    out = []
    for t in new:
        while times and times[0] <= t - window:
            times.popleft()
        ok = len(times) < most
        out.append((t, ok, 0.0 if ok else times[0] + window - t))
        if ok:
            times.append(t)
    return out


class RateLimiter(StatefulProcessor):
    """The state of a key is its times that still count; a timer at the end of the newest one's window clears it."""

    def __init__(self, window: float, most: int):
        self.window, self.most = window, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "at double")
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = deque(sorted(t for (t,) in self.times.get()) if self.times.exists() else ())
        new = sorted(t for part in rows for t in part["at"])
        out = allowed(times, new, self.window, self.most)
        self.times.put([(t,) for t in times])
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
        due = int((times[-1] + self.window) * 1000) + 1
        self.handle.registerTimer(due)
        self.due.update((due,))
        yield pd.DataFrame({"key": key[0], "at": [x[0] for x in out], "allowed": [x[1] for x in out], "retry_after": [x[2] for x in out]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.times.clear()
        self.due.clear()
        return iter(())

    def close(self) -> None:
        pass


def rate_limit(requests: DataFrame, window: float = RATE_SECONDS, most: int = RATE_MOST, late: str = "10 minutes") -> DataFrame:
    """Stream (key, ts) to (key, at, allowed, retry_after), at and retry_after in seconds.

    Requests of a key in one batch are taken by time; those more than `late`
    behind the newest of all are left out. Null keys are one key, rows without a
    time are left out. A key without requests for a window (and `late`) has no state.
    """
    use_rocksdb(requests.sparkSession)
    kind = requests.schema["key"].dataType.simpleString()
    rows = requests.select("key", F.col("ts").cast("timestamp").alias("ts")).where("ts is not null").withWatermark("ts", late)
    rows = rows.withColumn("at", F.unix_micros("ts") / 1e6)
    return rows.groupBy("key").transformWithStateInPandas(
        RateLimiter(window, most), f"key {kind}, at double, allowed boolean, retry_after double", "Append", "EventTime"
    )


# --- tasks ----------------------------------------------------------------------------------------------------

QUEUED, RUNNING, COMPLETED, FAILED = "queued", "processing", "completed", "failed"
ENDS = (COMPLETED, FAILED)
#: What a finished task shows: last step and its name; progress before the end stays below 100.
LAST_STEP, LAST_STAGE, MOST_PROGRESS = 5, "Complete", 99
TASK_DDL = "task_id {kind}, seq long, status string, step int, stage string, progress int, error string"


def advance(task: dict | None, update: dict) -> dict:
    """A task after an update (seq, status, step, stage, progress, error).

    Progress never falls. An end stays: later progress is ignored, only another
    end replaces it. A failed task keeps its progress, and its stage unless the update names one.
    """
    task = task or {"seq": -1, "status": QUEUED, "step": 0, "stage": "", "progress": 0, "error": None}
    status, seq = update["status"], int(update["seq"])  # columns with nulls hold floats
    if status == COMPLETED:
        return {"seq": seq, "status": status, "step": LAST_STEP, "stage": LAST_STAGE, "progress": 100, "error": None}
    if status == FAILED:
        return task | {"seq": seq, "status": status, "stage": update["stage"] or task["stage"], "error": update["error"]}
    if task["status"] in ENDS or status == QUEUED:
        return task
    progress = max(task["progress"], min(int(update["progress"] or 0), MOST_PROGRESS))
    return task | {"seq": seq, "status": RUNNING, "step": int(update["step"] or 0), "stage": update["stage"] or "", "progress": progress}


class TaskMachine(StatefulProcessor):
    """One value a task; with time to live, so tasks that are long over leave no state."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = "seq long, status string, step int, stage string, progress int, error string"
        self.task = handle.getValueState("task", schema, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = ("seq", "status", "step", "stage", "progress", "error")
        task = dict(zip(names, self.task.get(), strict=True)) if self.task.exists() else None
        updates = pd.concat(rows).sort_values("seq", kind="stable")
        for update in updates.astype(object).where(updates.notna(), None).to_dict("records"):
            task = advance(task, update)
        self.task.update(tuple(task[n] for n in names))
        yield pd.DataFrame([{"task_id": key[0]} | task])

    def close(self) -> None:
        pass


def task_states(updates: DataFrame, ttl_ms: int = TASK_TTL_MS) -> DataFrame:
    """Stream (task_id, seq, status, step, stage, progress, error) to each changed task's state after a batch.

    Updates of a task in one batch are taken by seq. See advance() for the
    rules; a task unknown to the state is queued. Run in update mode, and with
    empty_batches False where the stream is to end.
    """
    use_rocksdb(updates.sparkSession)
    kind = updates.schema["task_id"].dataType.simpleString()
    rows = updates.select(
        "task_id", F.col("seq").cast("long").alias("seq"), F.col("status").cast("string").alias("status"), F.col("step").cast("int").alias("step"),
        F.col("stage").cast("string").alias("stage"), F.col("progress").cast("int").alias("progress"), F.col("error").cast("string").alias("error"),
    )
    return rows.groupBy("task_id").transformWithStateInPandas(TaskMachine(ttl_ms), TASK_DDL.format(kind=kind), "Update", "ProcessingTime")


class ProgressLog(StreamingQueryListener):
    """Writes what each batch of a session's streams did to a folder, a JSON file a batch; read it with spark.read.json.

    Only counts and times pass through here. Files are named by run and batch, so a
    batch that is reported twice is there once.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _write(self, name: str, row: dict) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}.json")
        out = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
        try:
            out.write(bytearray(json.dumps(row).encode()))
        finally:
            out.close()

    def onQueryStarted(self, event) -> None:
        self._write(f"{event.runId}-start", {"event": "started", "run": str(event.runId), "name": event.name, "at": event.timestamp})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        state = p.stateOperators
        row = {"event": "progress", "run": str(p.runId), "name": p.name, "batch": p.batchId, "at": p.timestamp, "rows": p.numInputRows}
        row |= {"state_rows": sum(s.numRowsTotal for s in state), "millis": p.durationMs.get("triggerExecution")}
        self._write(f"{p.runId}-{p.batchId}", row)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._write(f"{event.runId}-end", {"event": "failed" if event.exception else "ended", "run": str(event.runId), "error": event.exception})
