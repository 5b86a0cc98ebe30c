"""E4 as a Structured Streaming worker (ST-3..ST-5, SNK-8, SNK-9).

New ballot questions arrive as parquet files.  Every micro-batch takes the
new questions plus stored questions whose current status is ERROR, retrieves context inside each question's filing,
calls the recommendation model once (output stored), and writes two sinks
from that one stored output: the recommendations and the status entries.
Both go to folders named by the batch id with overwrite, and the status is read
as earlier batches left it, so a re-run batch does the same questions and
replaces its own output.  The current recommendation of a question is the
one from its latest batch.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingflow.operators import model, status
from filingflow.plans import recommendation as rec
from filingflow.streaming import logs

RESULTS, STATUS = "results", "status"


STATUS_SCHEMA = ("filing_id long, question_id string, status string, error_msg string, "
                 "last_attempt timestamp, batch_id long")


def status_log(spark: SparkSession, state_dir: str, before: int | None = None) -> DataFrame:
    """Question status rows (snapshot + newer batches); ``seq`` = batch id."""
    return logs.read(spark, os.path.join(state_dir, STATUS), STATUS_SCHEMA, before).withColumnRenamed("batch_id", "seq")


def compact_status(spark: SparkSession, state_dir: str) -> int | None:
    """Snapshot the question log; later reads skip older folders."""
    return logs.compact(spark, os.path.join(state_dir, STATUS), STATUS_SCHEMA, rec.RESULT_KEY, ["batch_id"])


def current_recommendations(spark: SparkSession, state_dir: str) -> DataFrame:
    res = spark.read.parquet(os.path.join(state_dir, RESULTS))
    return status.current_status(res, rec.RESULT_KEY, ["batch_id"],
                                 ["voting_recommendation", "rationale", "citation", "confidence", "key_facts",
                                  "policy_breaches", "updated_at"])


def make_handler(questions_dir: str, state_dir: str, filings: DataFrame, chunks: DataFrame,
                 policies: DataFrame, fn: model.ModelFn, k: int = rec.REC_K):
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        log = status_log(spark, state_dir, batch_id)
        stored = spark.read.schema(batch.schema).parquet(questions_dir)
        cur = status.current_status(log, rec.RESULT_KEY, ["seq"], ["status"])
        retry = stored.join(cur.where(F.col("status") == "ERROR").select(*rec.RESULT_KEY), rec.RESULT_KEY, "left_semi")
        todo = batch.unionByName(retry).dropDuplicates(rec.RESULT_KEY)
        pending = rec.pending_questions(todo, filings, log)
        passages = rec.question_passages(pending, chunks, k)
        results, failures = rec.recommend(pending, passages, policies, fn, max_concurrency=None, chunks=chunks)
        results.write.mode("overwrite").parquet(os.path.join(state_dir, RESULTS, f"batch_id={batch_id}"))
        rec.status_entries(results, failures, batch_id).drop("seq") \
            .write.mode("overwrite").parquet(logs.log_path(os.path.join(state_dir, STATUS), batch_id))
    return handle


def start(spark: SparkSession, questions_dir: str, state_dir: str, filings: DataFrame, chunks: DataFrame,
          policies: DataFrame, fn: model.ModelFn, question_schema, available_now: bool = False,
          processing_time: str = "1 minute"):
    stream = spark.readStream.schema(question_schema).parquet(questions_dir)
    w = stream.writeStream.foreachBatch(make_handler(questions_dir, state_dir, filings, chunks, policies, fn)) \
        .option("checkpointLocation", os.path.join(state_dir, "_checkpoint"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.start()
