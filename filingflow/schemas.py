"""Declared table schemas and helpers.

Every stored table has a fixed schema; nothing is inferred.  The record
models of the extraction contracts (tallies, questions, recommendations) live
next to the model stages in ``operators.model``; their enums are re-exported
here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BooleanType, DateType, DoubleType, FloatType, IntegerType, LongType,
                               StringType, StructField, StructType, TimestampType)

from filingflow.operators.model import BOARD_VOTES, QUESTION_TYPES, RECOMMENDATIONS  # noqa: F401
from filingflow.operators.status import JOB_STATUSES, QUESTION_STATUSES  # noqa: F401


def _s(*fields: tuple[str, object]) -> StructType:
    return StructType([StructField(n, t) for n, t in fields])


# key (cik, meeting_date, question_id); counts nullable (null = not reported)
VOTES = _s(("cik", StringType()), ("ticker", StringType()), ("meeting_date", StringType()),
           ("question_id", StringType()), ("resolution", StringType()), ("total_votes", LongType()),
           ("for_votes", LongType()), ("against_votes", LongType()), ("abstentions", LongType()),
           ("broker_non_votes", LongType()), ("raw_json", StringType()))

# append-only status log of jobs; current status = latest (batch_id, seq)
JOB_STATUS_LOG = _s(("job_id", StringType()), ("status", StringType()), ("error", StringType()),
                    ("seq", IntegerType()), ("updated_at", TimestampType()), ("batch_id", LongType()))
JOB_REQUEST = _s(("id", StringType()), ("params", StringType()), ("created_at", TimestampType()))

# key proxy_id; filing_id = xxhash64(proxy_id)
PROXY_FILINGS = _s(("filing_id", LongType()), ("proxy_id", StringType()), ("cik", StringType()),
                   ("accession_number", StringType()), ("primary_document", StringType()),
                   ("filing_date", DateType()), ("form", StringType()), ("url", StringType()),
                   ("name", StringType()), ("ticker", StringType()), ("exchange", StringType()))

# key (filing_id, chunk_index)
PROXY_CHUNKS = _s(("filing_id", LongType()), ("chunk_index", IntegerType()), ("n_tokens", IntegerType()),
                  ("chunk_text", StringType()), ("embedding", ArrayType(FloatType())))

# key (filing_id, question_id)
PROXY_QUESTIONS = _s(("filing_id", LongType()), ("question_id", StringType()), ("question_text", StringType()),
                     ("board_vote_recommend", StringType()), ("question_type", StringType()),
                     ("is_shareholder", BooleanType()), ("question_embedding", ArrayType(FloatType())),
                     ("status", StringType()))

# key (filing_id, question_id)
RECOMMENDATIONS_TABLE = _s(("filing_id", LongType()), ("question_id", StringType()),
                           ("voting_recommendation", StringType()), ("rationale", StringType()),
                           ("citation", StringType()), ("confidence", DoubleType()),
                           ("key_facts", StringType()), ("policy_breaches", StringType()),
                           ("updated_at", TimestampType()))

QUESTION_STATUS_LOG = _s(("filing_id", LongType()), ("question_id", StringType()), ("status", StringType()),
                         ("error_msg", StringType()), ("seq", LongType()), ("last_attempt", TimestampType()))

TABLES = {"votes": VOTES, "job_status_log": JOB_STATUS_LOG, "job_requests": JOB_REQUEST,
          "proxy_filings": PROXY_FILINGS, "proxy_chunks": PROXY_CHUNKS, "proxy_questions": PROXY_QUESTIONS,
          "proxy_vote_engine_results": RECOMMENDATIONS_TABLE, "question_status_log": QUESTION_STATUS_LOG}


def empty(spark: SparkSession, schema: StructType) -> DataFrame:
    """An empty table with the schema (a first merge target)."""
    return spark.createDataFrame([], schema)


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Select the schema's columns in order, cast to its types; columns the
    frame lacks become typed nulls."""
    cols = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in cols else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in schema.fields])
