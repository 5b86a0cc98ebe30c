"""E1 ingest as a Structured Streaming job (ST-6, JN-2, SNK-5, SNK-6, SNK-10).

New filing-index files arrive in a folder.  Each micro-batch turns them into
rows, keeps proxy statements, skips filings already stored (unless listed for
re-ingest), joins their documents, cleans and chunks the text, and writes the
filings and chunks of the batch to folders named by the batch id (overwrite;
what is stored already is judged by earlier batches only, so a re-run batch
takes the same filings and replaces its own output).  The stored filing set is the
union of those folders; a re-ingested filing's latest batch wins.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingflow.operators import quality
from filingflow.plans import proxy_ingest
from filingflow.sources import filing_index
from filingflow.streaming import logs

FILINGS, CHUNKS, REJECTS = "filings", "chunks", "rejects"


def stored_filings(spark: SparkSession, state_dir: str, before: int | None = None) -> DataFrame:
    """Current filing rows (as batch ``before`` found them): the latest batch
    per ``proxy_id`` (snapshot + newer batches, see ``compact_filings``)."""
    rows = logs.read(spark, os.path.join(state_dir, FILINGS), None, before)
    if rows is None:
        return spark.createDataFrame([], "proxy_id string, filing_id long, batch_id long")
    latest = rows.groupBy("proxy_id").agg(F.max("batch_id").alias("batch_id"))
    return rows.join(latest, ["proxy_id", "batch_id"], "left_semi")


def compact_filings(spark: SparkSession, state_dir: str) -> int | None:
    """Snapshot the current filing rows; later micro-batches skip older folders."""
    return logs.compact(spark, os.path.join(state_dir, FILINGS), None, ["proxy_id"], ["batch_id"])


def stored_chunks(spark: SparkSession, state_dir: str) -> DataFrame:
    """Chunks of the current version of every filing (SNK-6 replace by key:
    only the chunks written with a filing's latest batch count)."""
    chunks = spark.read.parquet(os.path.join(state_dir, CHUNKS))
    latest = stored_filings(spark, state_dir).select("filing_id", "batch_id")
    return chunks.join(latest, ["filing_id", "batch_id"], "left_semi")


def make_handler(state_dir: str, documents: DataFrame, year: int | None = None,
                 redo: DataFrame | None = None, min_words: int = proxy_ingest.MIN_FILING_WORDS,
                 companies: DataFrame | None = None):
    """``companies`` is the directory ``(cik, ticker, company_name, ...)`` that
    filings are joined with (JN-1); those without an entry keep nulls."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        pages = batch.select("cik", "source_file", filing_index.page_struct(batch).alias("page"))
        rows, bad_pages = filing_index.index_rows(pages, ["cik", "source_file"])
        selected = proxy_ingest.select_proxy_filings(filing_index.normalise(rows), year)
        done = stored_filings(spark, state_dir, batch_id).select("proxy_id")
        new = proxy_ingest.new_filings(selected, done, redo)
        # cleaned once per batch: kept filings and rejects both read it
        tagged = proxy_ingest.tag_filing_texts(new, documents, min_words=min_words).persist()
        texts, rejects = quality.split(tagged)
        filings = proxy_ingest.filing_records(texts, companies).persist()
        filings.drop("text").write.mode("overwrite").parquet(
            logs.log_path(os.path.join(state_dir, FILINGS), batch_id))
        proxy_ingest.filing_chunks(filings).write.mode("overwrite").parquet(
            os.path.join(state_dir, CHUNKS, f"batch_id={batch_id}"))
        rejects.select("proxy_id", "reject_reason").unionByName(
            bad_pages.select(F.col("source_file").alias("proxy_id"), F.col("reason").alias("reject_reason"))) \
            .write.mode("overwrite").parquet(os.path.join(state_dir, REJECTS, f"batch_id={batch_id}"))
        filings.unpersist()
        tagged.unpersist()
    return handle


def start(spark: SparkSession, index_dir: str, state_dir: str, documents: DataFrame, year: int | None = None,
          redo: DataFrame | None = None, available_now: bool = False, processing_time: str = "10 minutes",
          multi_line: bool = True, companies: DataFrame | None = None):
    """``multi_line``: one JSON document per file (as published) or JSON lines."""
    stream = spark.readStream.schema(filing_index.INDEX_FILE_SCHEMA).option("multiLine", multi_line).json(index_dir) \
        .withColumn("source_file", F.col("_metadata.file_path"))
    w = stream.writeStream.foreachBatch(make_handler(state_dir, documents, year, redo, companies=companies)) \
        .option("checkpointLocation", os.path.join(state_dir, "_checkpoint"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.start()
