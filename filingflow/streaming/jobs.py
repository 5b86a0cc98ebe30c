"""Job queue as a Structured Streaming query (ST-1..ST-6, SNK-9, SNK-11, SL-2).

Job requests are JSON files dropped into a folder.  A streaming file source
picks up new files (the checkpoint remembers which were read, so replaying the
same file adds nothing), and ``foreachBatch`` runs the batch job over *all*
pending requests at once.

Replay: every output of micro-batch ``b`` is written to folders named after
``b`` with overwrite, and what is done already is judged by earlier batches
only.  A batch that runs again after an executor or driver loss therefore does
the same jobs and replaces its own output.  Job status is an
append-only log; the current status is the entry with the greatest sequence.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, TimestampType

from filingflow.operators import status as st
from filingflow.streaming import logs

JOB_SCHEMA = StructType([
    StructField("id", StringType()),
    StructField("params", StringType()),
    StructField("created_at", TimestampType()),
])

STATUS_DIR = "status"
RESULT_DIR = "results"
REJECT_DIR = "rejects"
PAYLOAD_DIR = "payloads"
VOTE_DIR = "votes"

# seq values of the life-cycle steps inside one micro-batch
_SEQ_RUNNING, _SEQ_FINAL = 1, 2


def job_id(params_col: str = "params", created_col: str = "created_at"):
    """SC-18: deterministic job id from the request (not a random uuid), so a
    re-delivered request maps to the same job."""
    return F.sha2(F.concat_ws("|", F.col(params_col), F.col(created_col).cast("string")), 256).substr(1, 32)


def write_requests(requests: DataFrame, incoming_dir: str) -> None:
    """SNK-11: append job requests (``params`` JSON, ``created_at``) as files."""
    out = requests.withColumn("id", F.coalesce(F.col("id"), job_id())) if "id" in requests.columns \
        else requests.withColumn("id", job_id())
    out.select("id", "params", "created_at").write.mode("append").json(incoming_dir)


STATUS_SCHEMA = "job_id string, status string, error string, seq int, updated_at timestamp, batch_id bigint"


def read_status(spark: SparkSession, state_dir: str, before: int | None = None) -> DataFrame:
    """Status rows needed for the current state (as batch ``before`` found it):
    latest snapshot + newer batches."""
    return logs.read(spark, os.path.join(state_dir, STATUS_DIR), STATUS_SCHEMA, before)


def compact_status(spark: SparkSession, state_dir: str) -> int | None:
    """Snapshot the current status of every job (a new folder); later reads
    skip all log folders up to the returned batch id."""
    return logs.compact(spark, os.path.join(state_dir, STATUS_DIR), STATUS_SCHEMA, ["job_id"], ["batch_id", "seq"])


def current_jobs(spark: SparkSession, state_dir: str) -> DataFrame:
    """ST-2 / FLT-13: current status of every job."""
    log = read_status(spark, state_dir)
    return st.current_status(log, ["job_id"], ["batch_id", "seq"], ["status", "error", "updated_at"])


def make_batch_handler(state_dir: str, process: Callable[[DataFrame], DataFrame],
                       store: Callable[[DataFrame, int], None] | None = None):
    """``foreachBatch`` handler.

    ``process(jobs)`` receives ``(job_id, params, created_at)`` for the jobs
    not yet done and returns result rows with a ``job_id`` column plus an
    optional ``error`` column (null = ok).  Jobs without result rows finish
    ``done`` with an empty result.  ``store(results, batch_id)`` keeps them in
    further tables before the jobs get their final status; an error in it fails
    the batch, which then runs again under the same id.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        jobs = batch.select(F.col("id").alias("job_id"), "params", "created_at").dropDuplicates(["job_id"])
        # only this batch's jobs matter: narrow the log before taking the latest entry
        log = read_status(spark, state_dir, batch_id).join(jobs.select("job_id"), "job_id", "left_semi")
        done = st.current_status(log, ["job_id"], ["batch_id", "seq"], ["status"]) \
            .where(F.col("status") == "done").select("job_id")
        todo = jobs.join(done, "job_id", "left_anti").persist()
        status_path = logs.log_path(os.path.join(state_dir, STATUS_DIR), batch_id)
        result_path = os.path.join(state_dir, RESULT_DIR, f"batch_id={batch_id}")
        now, stored = F.current_timestamp(), None
        running = todo.select("job_id", F.lit("running").alias("status"),
                              F.lit(None).cast("string").alias("error"),
                              F.lit(_SEQ_RUNNING).alias("seq"), now.alias("updated_at"))
        # visible while the work goes on; the final write replaces it
        running.write.mode("overwrite").parquet(status_path)
        try:
            results = process(todo)
            if "error" not in results.columns:
                results = results.withColumn("error", F.lit(None).cast("string"))
            results.write.mode("overwrite").parquet(result_path)
            stored = spark.read.parquet(result_path)
            errors = stored.groupBy("job_id").agg(F.max("error").alias("error"))
        except Exception as e:  # noqa: BLE001 -- Q14: the batch outcome sets every job's status
            msg = f"{type(e).__name__}: {e}"
            errors = todo.select("job_id", F.lit(msg).alias("error"))
        if store is not None and stored is not None:
            store(stored, batch_id)
        final = todo.select("job_id").join(errors, "job_id", "left").select(
            "job_id", F.when(F.col("error").isNull(), "done").otherwise("error").alias("status"),
            "error", F.lit(_SEQ_FINAL).alias("seq"), now.alias("updated_at"))
        # the batch id is carried by the folder name (partition column)
        running.unionByName(final).select("job_id", "status", "error", "seq", "updated_at") \
            .write.mode("overwrite").parquet(status_path)
        todo.unpersist()
    return handle


def start_worker(spark: SparkSession, incoming_dir: str, state_dir: str,
                 process: Callable[[DataFrame], DataFrame], processing_time: str | None = "1 minute",
                 available_now: bool = False, max_files_per_trigger: int | None = None,
                 store: Callable[[DataFrame, int], None] | None = None):
    """ST-1: poll ``incoming_dir``; every trigger processes the whole backlog
    (or ``max_files_per_trigger`` files) in one batch job."""
    reader = spark.readStream.schema(JOB_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.json(incoming_dir)
    w = stream.writeStream.foreachBatch(make_batch_handler(state_dir, process, store)) \
        .option("checkpointLocation", os.path.join(state_dir, "_checkpoint"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.start()


def job_results(spark: SparkSession, state_dir: str) -> DataFrame:
    """Result rows of the latest batch that completed each job."""
    res = spark.read.parquet(os.path.join(state_dir, RESULT_DIR))
    cur = current_jobs(spark, state_dir)
    log = read_status(spark, state_dir).where(F.col("seq") == _SEQ_FINAL) \
        .groupBy("job_id").agg(F.max("batch_id").alias("batch_id"))
    return res.join(log, ["job_id", "batch_id"]).join(cur.select("job_id", "status"), "job_id")


def lookup(spark: SparkSession, incoming_dir: str, state_dir: str) -> DataFrame:
    """FLT-13 / ST-2: every request ``(job_id, params, created_at)`` with its
    ``status`` (``pending`` until a batch takes it up), ``error`` and, once it
    is done, ``result``: the JSON array of the last batch that stored one."""
    req = spark.read.schema(JOB_SCHEMA).json(incoming_dir) \
        .select(F.col("id").alias("job_id"), "params", "created_at").dropDuplicates(["job_id"])
    path = os.path.join(state_dir, PAYLOAD_DIR)
    schema = "job_id string, result string, batch_id bigint"
    try:
        payloads = spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        payloads = spark.createDataFrame([], schema)
    payloads = payloads.groupBy("job_id").agg(F.max_by("result", "batch_id").alias("result"))
    cur = current_jobs(spark, state_dir)
    status = F.coalesce("status", F.lit("pending"))
    return req.join(cur, "job_id", "left").join(payloads, "job_id", "left").select(
        "job_id", "params", "created_at", status.alias("status"), "error",
        F.when(status == "done", F.coalesce("result", F.lit("[]"))).alias("result"))


def oldest_pending_job(spark: SparkSession, requests: DataFrame, state_dir: str, n: int = 1) -> DataFrame:
    """SL-2: the n oldest requests that have no status yet (created_at, id)."""
    seen = read_status(spark, state_dir).select("job_id").distinct()
    pending = requests.join(seen, requests.id == seen.job_id, "left_anti")
    return pending.orderBy("created_at", "id").limit(n)
