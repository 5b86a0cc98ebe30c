"""E3: meeting requests -> newest meetings or explicit ids -> stored documents.

All requests of a batch are answered by one plan: validation (FLT-11),
per-request selection (WN-1/WN-2/JN-6), document join (JN-7, FLT-10), keyed
JSON sink (SNK-1), and one diagnostics table for everything that produced
nothing (FLT-14).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingflow.sources import meetings


def fetch(requests: DataFrame, feed: DataFrame, documents: DataFrame, out_dir: str | None = None,
          default_n: int = meetings.DEFAULT_MEETINGS) -> tuple[DataFrame, DataFrame]:
    """``requests``: request_id, ticker, isin, n, meeting_ids (array, optional).
    ``feed``: raw feed rows (``meetings.read_feed``); ``documents``:
    ``(meeting_id, payload)``.  Returns ``(stored documents, diagnostics)``."""
    if "meeting_ids" not in requests.columns:
        requests = requests.withColumn("meeting_ids", F.lit(None).cast("array<string>"))
    good, invalid = meetings.validate_requests(requests)
    rows = meetings.feed_rows(feed)
    chosen, empty = meetings.select_meetings(good, rows, default_n)
    docs, failed = meetings.fetch_documents(chosen, documents)
    if out_dir:
        meetings.write_documents(docs, out_dir)
    diag = (invalid.select("request_id", F.col("reject_reason").alias("reason"))
            .unionByName(empty.select("request_id", "reason"))
            .unionByName(failed.select("request_id", F.concat_ws(": ", "reject_reason", "meeting_id").alias("reason"))))
    return docs.select("request_id", "ticker", "isin", "meeting_id", "payload"), diag
