"""Job and question life cycles as keyed streaming state (ST-1..ST-3, ST-5, SNK-9, SNK-11).

One state per item, kept by Spark's state store: pending, running, done or
error, with the number of tries.  Two kinds of files feed it, requests and the
outcomes that the worker itself writes; processing-time timers do the rest:

- a request makes an unknown item pending and sets a timer that is due at once,
  so the next micro-batch runs it; a repeated request adds nothing;
- a running item has a lease: without an outcome in time (a lost driver, say)
  it is tried again;
- an outcome of the current try makes it done or error, outcomes of earlier
  tries are ignored; after an error a timer waits ``retry_after`` and the item
  runs again, ``tries`` times in all.  No new file is needed for that.

Every change is a row of the status table, numbered by item.  A micro-batch
writes its rows, results and outcomes to folders named by its id with overwrite
before it commits.  A batch that is run again starts from the state before it,
with the same input and time, so it makes the same rows and replaces its files.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from filingflow.operators import status as st

EVENTS = "id string, params string, created_at timestamp, try int, error string"
STATE = "status string, try int, seq int, params string, created_at timestamp"
CHANGES = "id string, seq int, status string, try int, params string, created_at timestamp, error string, at_ms long"
FINAL = ("done", "failed")

_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class LifeCycle(StatefulProcessor):
    """pending -> running -> done | error -> running ... | failed."""

    def __init__(self, tries: int, retry_after: int, lease: int):
        self.tries, self.retry_after, self.lease = tries, retry_after, lease

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("item", STATE)

    def _change(self, key, status: str, number: int, seq: int, params, created_at, error, now: int, due: int | None) -> Row:
        if due is not None:
            self.handle.registerTimer(due)
        self.state.update((status, number, seq, params, created_at))
        return Row(id=key[0], seq=seq, status=status, **{"try": number}, params=params, created_at=created_at, error=error, at_ms=now)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        # requests first, of several the earliest; then outcomes by try
        for r in sorted(rows, key=lambda r: (r["try"] or 0, str(r["created_at"]), r["params"] or "")):
            known = self.state.get()
            if r["try"] is None:
                if known is None:
                    yield self._change(key, "pending", 0, 1, r["params"], r["created_at"], None, now, now)
                continue
            if known is None:
                continue
            status, number, seq, params, created_at = known
            if status != "running" or number != r["try"]:
                continue
            for timer in list(self.handle.listTimers()):  # the lease
                self.handle.deleteTimer(timer)
            if r["error"] is None:
                yield self._change(key, "done", number, seq + 1, params, created_at, None, now, None)
            elif number >= self.tries:
                yield self._change(key, "failed", number, seq + 1, params, created_at, r["error"], now, None)
            else:
                yield self._change(key, "error", number, seq + 1, params, created_at, r["error"], now, now + self.retry_after)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # an item has one timer at most, and Spark deletes the one that is due
        now = timerValues.getCurrentProcessingTimeInMs()
        status, number, seq, params, created_at = self.state.get()
        if status == "running" and number >= self.tries:
            yield self._change(key, "failed", number, seq + 1, params, created_at, "no outcome in time", now, None)
        elif status in ("pending", "running", "error"):
            yield self._change(key, "running", number + 1, seq + 1, params, created_at, None, now, now + self.lease)

    def close(self) -> None:
        pass


def request(items: DataFrame, base: str) -> None:
    """Append requests (id, params, created_at) as files."""
    items.select("id", "params", "created_at").write.mode("append").json(os.path.join(base, "requests"))


def changes(spark: SparkSession, base: str) -> DataFrame:
    """All rows of the status table, with batch_id; empty before the first."""
    schema = f"{CHANGES}, batch_id long"
    try:
        return spark.read.schema(schema).parquet(os.path.join(base, "status"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def current(spark: SparkSession, base: str) -> DataFrame:
    """SNK-9 / FLT-13: every item's status, tries, error and time."""
    return st.current_status(changes(spark, base), ["id"], ["seq"], ["status", "try", "params", "created_at", "error", "at_ms"])


def count_final(spark: SparkSession, base: str) -> int:
    """Items that are done or failed: each gets one such row, so nothing is grouped."""
    return changes(spark, base).where(F.col("status").isin(*FINAL)).count()


def results(spark: SparkSession, base: str) -> DataFrame:
    """Result rows of the tries that ended well."""
    done = current(spark, base).where("status = 'done'").select("id", "try")
    return spark.read.parquet(os.path.join(base, "results")).drop("batch_id").join(done, ["id", "try"])


def make_handler(base: str, process: Callable[[DataFrame], DataFrame]):
    """``process`` takes (id, params, created_at, try) of items to run and returns rows with ``id`` and, optionally,
    ``error``; an item without rows is done.  An exception in it is the outcome of all items of the batch, which are
    tried again; one in writing fails the batch, which Spark repeats."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        at = {name: os.path.join(base, name, f"batch_id={batch_id}") for name in ("status", "results", "outcomes")}
        batch.write.mode("overwrite").parquet(at["status"])
        due = spark.read.schema(CHANGES).parquet(at["status"]).where("status = 'running'").select("id", "params", "created_at", "try")
        if due.isEmpty():
            return
        try:
            made = process(due)
            made = made if "error" in made.columns else made.withColumn("error", F.lit(None).cast("string"))
            made.drop("try").join(due.select("id", "try"), "id").write.mode("overwrite").parquet(at["results"])
            errors = spark.read.parquet(at["results"]).groupBy("id").agg(F.max("error").alias("error"))
        except OSError:
            raise
        except Exception as e:  # noqa: BLE001 -- the outcome of these tries
            errors = due.select("id", F.lit(f"{type(e).__name__}: {e}").alias("error"))
        due.select("id", "try").join(errors, "id", "left").select("id", "try", "error").write.mode("overwrite").json(at["outcomes"])
    return handle


def start(spark: SparkSession, base: str, process: Callable[[DataFrame], DataFrame], tries: int = 3, retry_after: int = 30_000, lease: int = 900_000, processing_time: str = "1 minute"):
    """The worker: polls for requests, runs what is due, retries what failed; times in milliseconds."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    streams = []
    for name in ("requests", "outcomes"):
        fs.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(os.path.join(base, name)))
        streams.append(spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").json(os.path.join(base, name)))
    events = streams[0].unionByName(streams[1])
    life = events.groupBy("id").transformWithState(LifeCycle(tries, retry_after, lease), CHANGES, "Append", "ProcessingTime")
    before = spark.conf.get(_PROVIDER[0], None)
    spark.conf.set(*_PROVIDER)  # timers need this state store; the query keeps the session's settings of its start
    try:
        return life.writeStream.foreachBatch(make_handler(base, process)).option("checkpointLocation", os.path.join(base, "checkpoint")).trigger(processingTime=processing_time).start()
    finally:
        spark.conf.unset(_PROVIDER[0]) if before is None else spark.conf.set(_PROVIDER[0], before)
