"""Shareholder-meeting feeds (SRC-4, SRC-5, FLT-9..FLT-11, WN-1, WN-2, JN-6,
FLT-14, SNK-1).

A feed file per ticker holds ``companies[{isin, meetings[{meetingId,
meetingDate}]}]``.  Two ``posexplode`` steps flatten it while keeping feed
positions, so "first matching company" and "ties keep feed order" are plain
orderings.  All requests are answered in one plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from filingflow.operators import quality, ranking
from filingflow.session import materialize

# Default number of meetings per security.
DEFAULT_MEETINGS = 5

MEETING_SCHEMA = StructType([StructField("meetingId", StringType()), StructField("meetingDate", StringType())])
FEED_SCHEMA = StructType([
    StructField("ticker", StringType()),
    StructField("companies", ArrayType(StructType([
        StructField("isin", StringType()),
        StructField("meetings", ArrayType(MEETING_SCHEMA)),
    ]))),
])


def read_feed(spark: SparkSession, paths, lines: bool = False) -> DataFrame:
    """SRC-4: one feed per file, or one per line (``lines``), which splits large files."""
    return spark.read.schema(FEED_SCHEMA).option("multiLine", not lines).json(paths)


def feed_rows(feed: DataFrame) -> DataFrame:
    """``(ticker, company_pos, isin, meeting_pos, meeting_id, meeting_date)``;
    a company without meetings keeps one row with null meeting fields."""
    c = feed.select("ticker", F.posexplode_outer("companies").alias("company_pos", "c"))
    m = c.select("ticker", "company_pos", F.col("c.isin").alias("isin"),
                 F.posexplode_outer("c.meetings").alias("meeting_pos", "m"))
    return m.select("ticker", "company_pos", "isin", "meeting_pos",
                    F.col("m.meetingId").alias("meeting_id"), F.col("m.meetingDate").alias("meeting_date"))


def read_meeting_documents(spark: SparkSession, path: str) -> DataFrame:
    """SRC-5: one JSON document per file named ``<meeting_id>.json``."""
    docs = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_name"))
    return docs.select(F.regexp_extract("file", r"^(.*)\.json$", 1).alias("meeting_id"),
                       F.col("value").alias("payload"))


def validate_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """FLT-11 + Q18: isin and ticker required, n >= 1 when given.  Stored once, as both sides are read several times."""
    n_ok = F.col("n").isNull() | (F.col("n") >= 1) if "n" in requests.columns else F.lit(True)
    tagged = quality.validate(requests, [("isin is required", quality.present("isin")),
                                         ("ticker is required", quality.present("ticker")),
                                         ("n must be at least 1", n_ok)])
    return quality.split(materialize(tagged, "meeting-requests"))


def _newest(requests: DataFrame, rows: DataFrame, default_n: int) -> tuple[DataFrame, DataFrame]:
    """The newest ``n`` meetings per request (WN-1), stored once, and the requests without any.

    WN-2: per (ticker, isin) only the first company in feed order counts; its rows come first in
    the ranking, those without a meeting after the others, so one pass over the feed is enough.
    """
    req = requests.withColumn("n", F.coalesce(F.col("n"), F.lit(default_n))) if "n" in requests.columns \
        else requests.withColumn("n", F.lit(default_n))
    no_meeting = F.col("meeting_id").isNull()
    top = ranking.top_n_varying(rows, req.select("request_id", "ticker", "isin", "n"), ["ticker", "isin"],
                                [F.asc("company_pos"), no_meeting.asc(), F.desc("meeting_date"), F.asc("meeting_pos")],
                                first_of="company_pos").where(~no_meeting) \
        .select("request_id", "ticker", "isin", "meeting_id", "meeting_date", "rank")
    top = materialize(top, "meetings-listed")
    return top, quality.diagnostics(req, top, ["request_id"], F.lit(None).cast("string")).drop("reason")


def list_meetings(requests: DataFrame, rows: DataFrame, default_n: int = DEFAULT_MEETINGS
                  ) -> tuple[DataFrame, DataFrame]:
    """WN-1: newest ``n`` meetings per request (``request_id, ticker, isin, n``).

    Newest = meeting date descending as text; ties keep feed order.  Returns
    ``(meetings, diagnostics)``; a request without meetings gets a reason
    (ticker unknown / ticker known but ISIN not in its feed).
    """
    top, miss = _newest(requests, rows, default_n)
    known = rows.select("ticker").distinct().withColumn("_known", F.lit(True))
    diag = miss.join(known, "ticker", "left").select("request_id", "ticker", "isin", F.when(F.col("_known"), F.format_string(
        "No company of ticker '%s' has the ISIN '%s'", F.col("ticker"), F.col("isin")))
        .otherwise(F.format_string("No feed for ticker '%s'", F.col("ticker"))).alias("reason"))
    return top, diag


def select_meetings(requests: DataFrame, rows: DataFrame, default_n: int = DEFAULT_MEETINGS
                    ) -> tuple[DataFrame, DataFrame]:
    """JN-6: per request the explicit ``meeting_ids`` when given, else its
    newest ``n``.  Returns ``(request_id, ticker, isin, meeting_id)`` and
    diagnostics for requests left with nothing."""
    has_ids = F.coalesce(F.size("meeting_ids") > 0, F.lit(False))
    explicit = requests.where(has_ids).select("request_id", "ticker", "isin",
                                               F.explode("meeting_ids").alias("meeting_id"))
    listed, miss = _newest(requests.where(~has_ids).drop("meeting_ids"), rows, default_n)
    chosen = explicit.unionByName(listed.select("request_id", "ticker", "isin", "meeting_id"))
    return chosen, miss.select("request_id", "ticker", "isin", F.lit("no meetings found").alias("reason"))


def fetch_documents(chosen: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JN-7 + FLT-10: attach payloads; missing ones and those that say "Not
    found" with status "warning" go to rejects, other warnings are kept.  The join is stored
    once for both."""
    j = chosen.join(documents, "meeting_id", "left")
    absent = (F.get_json_object("payload", "$.status") == "warning") & (F.get_json_object("payload", "$.message") == "Not found")
    tagged = quality.validate(j, [
        ("document missing", F.col("payload").isNotNull()),
        ("not found / warning payload", ~F.coalesce(absent, F.lit(False))),
    ])
    return quality.split(materialize(tagged, "meeting-documents"))


def write_documents(docs: DataFrame, base: str) -> None:
    """SNK-1: ``base/security=<ticker>_<isin>/meeting_id=<id>/`` JSON, replacing
    only the meetings present in this batch (dynamic partition overwrite)."""
    out = docs.withColumn("security", F.concat_ws("_", "ticker", "isin"))
    (out.select("security", "meeting_id", "payload").write
     .option("partitionOverwriteMode", "dynamic").mode("overwrite")
     .partitionBy("security", "meeting_id").json(base))
