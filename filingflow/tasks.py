"""One function per user-facing task, over files and tables.

These are the operations a user of a per-company filing service performs --
list and fetch meetings, submit and poll vote-extraction jobs, turn PDFs into
text, ingest proxy statements, extract ballot questions, produce
recommendations -- each answered for *all* requested companies in one Spark
plan.  They only wire readers to the plans; the work is in ``plans`` and
``operators``.
"""

from __future__ import annotations

import datetime
import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingflow.functions import keys
from filingflow.operators import model, quality
from filingflow.plans import meeting_fetch, pdf_text, proxy_ingest, recommendation, vote_extraction
from filingflow.sources import directory, filing_index, meetings
from filingflow.streaming import jobs


# -- meetings ---------------------------------------------------------------

def list_meetings(spark: SparkSession, feed_path: str, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Newest meetings per request ``(request_id, ticker, isin, n)``."""
    good, invalid = meetings.validate_requests(requests)
    found, diag = meetings.list_meetings(good, meetings.feed_rows(meetings.read_feed(spark, feed_path)))
    return found, diag.unionByName(invalid.select("request_id", "ticker", "isin",
                                                  F.col("reject_reason").alias("reason")))


def fetch_meetings(spark: SparkSession, feed_path: str, documents_path: str, requests: DataFrame,
                   out_dir: str) -> tuple[DataFrame, DataFrame]:
    """Store meeting documents under ``out_dir/security=<ticker>_<isin>/``."""
    docs = meetings.read_meeting_documents(spark, documents_path)
    return meeting_fetch.fetch(requests, meetings.read_feed(spark, feed_path), docs, out_dir)


# -- vote-extraction jobs -----------------------------------------------------

def submit_vote_jobs(spark: SparkSession, incoming_dir: str, requests: Iterable[tuple[str, int]]) -> DataFrame:
    """Queue one job per ``(cik, year)``; returns ``(id, params, created_at)``."""
    # one fixed submission time, so the ids written and the ids returned agree
    submitted = datetime.datetime.now().replace(microsecond=0)
    rows = [(str(c), int(y)) for c, y in requests]
    df = spark.createDataFrame(rows, "cik string, year int").select(
        F.to_json(F.struct("cik", "year")).alias("params"), F.lit(submitted).alias("created_at"))
    df = df.withColumn("id", jobs.job_id())
    jobs.write_requests(df, incoming_dir)
    return df


def job_status(spark: SparkSession, state_dir: str, job_id: str | None = None) -> DataFrame:
    """Current status of every job, or of one job (point lookup)."""
    cur = jobs.current_jobs(spark, state_dir)
    return cur if job_id is None else cur.where(F.col("job_id") == job_id)


def job_lookup(spark: SparkSession, incoming_dir: str, state_dir: str, job_id: str | None = None) -> DataFrame:
    """Requests with status, error and the JSON result of those done; of one job or all."""
    found = jobs.lookup(spark, incoming_dir, state_dir)
    return found if job_id is None else found.where(F.col("job_id") == job_id)


def stored_votes(spark: SparkSession, state_dir: str) -> DataFrame:
    """Every vote that the worker has stored, one row per company, meeting and question."""
    return vote_extraction.vote_table(spark, state_dir).read()


def job_results(spark: SparkSession, state_dir: str, job_id: str | None = None) -> DataFrame:
    res = jobs.job_results(spark, state_dir)
    return res if job_id is None else res.where(F.col("job_id") == job_id)


def run_vote_worker(spark: SparkSession, incoming_dir: str, state_dir: str, index_path: str,
                    documents: DataFrame, companies: DataFrame, fn: model.ModelFn | None = None,
                    once: bool = True, processing_time: str = "1 minute"):
    """Drain the job folder (``once``) or poll it every ``processing_time``.

    Index pages that cannot be read as rows are written to
    ``state_dir/rejects``; the jobs of their companies end with that reason.
    Tallies are stored in the vote table below ``state_dir`` (``stored_votes``)
    and with their job (``job_lookup``) before it is done.  Without ``fn`` they
    are read from the documents' own tables.
    """
    raw = filing_index.read_index_files(spark, index_path)
    pages, unlisted = filing_index.company_pages(raw)
    rows, bad_pages = filing_index.index_rows(pages, ["cik", "source_file"])
    bad_pages = bad_pages.unionByName(unlisted)
    bad_pages.write.mode("overwrite").parquet(os.path.join(state_dir, jobs.REJECT_DIR))
    process = vote_extraction.job_processor(filing_index.normalise(rows), documents, companies, fn,
                                            bad_pages=bad_pages)
    q = jobs.start_worker(spark, incoming_dir, state_dir, process, processing_time=processing_time,
                          available_now=once, store=vote_extraction.vote_store(state_dir))
    if once:
        q.awaitTermination()
    return q


# -- documents ----------------------------------------------------------------

def pdf_to_text(spark: SparkSession, path: str, extractor=None) -> tuple[DataFrame, DataFrame]:
    """Text of every PDF below ``path``: ``(texts, rejects)``."""
    return pdf_text.extract(spark, path, extractor)


def ingest_proxy_statements(spark: SparkSession, index_path: str, documents: DataFrame, stored: DataFrame,
                            year: int | None = None, directory_path: str | None = None,
                            redo: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New proxy statements of ``year`` -> ``(filings, chunks, rejects)``.

    ``documents`` is ``(url, html)``; ``stored`` holds the ``proxy_id`` of
    filings already ingested (skipped unless listed in ``redo``).  Rejects
    include index pages that cannot be read as rows, with their file as
    ``proxy_id``.  The cleaned documents are persisted once (all three results read them);
    ``unpersist`` the filings when done.
    """
    raw = filing_index.read_index_files(spark, index_path)
    pages, unlisted = filing_index.company_pages(raw, year)
    rows, bad_pages = filing_index.index_rows(pages, ["cik", "source_file"])
    bad_pages = bad_pages.unionByName(unlisted)
    selected = proxy_ingest.select_proxy_filings(filing_index.normalise(rows), year)
    new = proxy_ingest.new_filings(selected, stored, redo)
    tagged = proxy_ingest.tag_filing_texts(new, documents).persist()
    texts, rejects = quality.split(tagged)
    rejects = rejects.unionByName(
        bad_pages.select(keys.pad_cik("cik").alias("cik"), F.col("source_file").alias("proxy_id"),
                         F.col("reason").alias("reject_reason")), allowMissingColumns=True)
    companies = directory.directory_rows(directory.read_directory_files(spark, directory_path)) \
        if directory_path else None
    filings = proxy_ingest.filing_records(texts, companies)
    return filings.drop("text"), proxy_ingest.filing_chunks(filings), rejects


def extract_ballot_questions(chunks: DataFrame, fn: model.ModelFn, embedder=None) -> tuple[DataFrame, DataFrame]:
    """Embed chunks, retrieve context per filing, extract questions."""
    emb = proxy_ingest.embed_chunks(chunks, embedder)
    ctx = proxy_ingest.retrieval_context(emb, proxy_ingest.query_vectors(embedder))
    return proxy_ingest.extract_questions(ctx, fn)


def recommend_votes(questions: DataFrame, filings: DataFrame, chunks_embedded: DataFrame, policies: DataFrame,
                    fn: model.ModelFn, status_log: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Recommendations for pending questions: ``(results, status entries)``."""
    pending = recommendation.pending_questions(questions, filings, status_log)
    passages = recommendation.question_passages(pending, chunks_embedded)
    results, failures = recommendation.recommend(pending, passages, policies, fn, chunks=chunks_embedded)
    return results, recommendation.status_entries(results, failures, 1)
