"""E2: 8-K voting results -> validated tallies -> insert-ignore vote table.

For every job ``(job_id, cik, year)``: the company's 8-K filings of the year
that list item 5.07, the latest filing per meeting, its document, the
"Item 5.07" text check, style-stripped HTML to the model, validated tallies.
All jobs of a micro-batch run as one plan.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingflow.functions import forms, keys, text
from filingflow.operators import bucketed, concat, latest, merge, model, quality, tallies, vote_tables
from filingflow.streaming import jobs as jobs_dirs

VOTE_KEY = ["cik", "meeting_date", "question_id"]
VOTE_COLUMNS = ["cik", "ticker", "meeting_date", "question_id", "resolution", "total_votes",
                "for_votes", "against_votes", "abstentions", "broker_non_votes", "raw_json"]

#: Rejects that leave a job done: the document is passed over.
SKIPPED = ("ticker missing", "meeting_date missing")

VOTE_SCHEMA = ("cik string, ticker string, meeting_date string, question_id string, resolution string, "
               "total_votes bigint, for_votes bigint, against_votes bigint, abstentions bigint, "
               "broker_non_votes bigint, raw_json string")

TALLY_PROMPT = "Extract the Item 5.07 voting results of this filing as JSON.\n\n%s"


def candidate_filings(jobs: DataFrame, index_rows: DataFrame, strict: bool = False) -> DataFrame:
    """FLT-1/2/4 + AG-1: per job, the latest 8-K per meeting date.

    ``index_rows`` is a normalised index (cik, accessionNumber, filing_date,
    meeting_date, form, items, primaryDocument, optional present_cols).  The
    grouping date falls back per company index, not per row: when any page
    of the company's index carries the meeting-date column, filings are
    grouped by meeting date and those without one are dropped; only a
    company whose index has no such column is grouped by filing date.
    """
    idx = index_rows.withColumn("cik", keys.pad_cik("cik"))
    has_col = F.array_contains("present_cols", "meetingDate") if "present_cols" in idx.columns \
        else F.col("meeting_date").isNotNull()
    # one flag per company (a map-side combined aggregate over its index rows)
    per_company = idx.groupBy("cik").agg(F.max(has_col).alias("_meeting_col"))
    j = jobs.select("job_id", keys.pad_cik("cik").alias("cik"), "year").join(idx, "cik")
    sel = j.where((F.year("filing_date") == F.col("year")) & forms.form_matches("form")
                  & forms.items_include("items"))
    sel = sel.join(per_company, "cik").withColumn(
        "group_date", F.when(F.col("_meeting_col"), F.col("meeting_date")).otherwise(F.col("filing_date")))
    cols = ["accessionNumber", "primaryDocument", "filing_date", "form"]
    if strict:
        return latest.latest_whole_row(sel, ["job_id", "cik", "group_date"], ["filing_date", "accessionNumber"], cols)
    return latest.latest_nonnull(sel, ["job_id", "cik", "group_date"], "accessionNumber", cols)


def filing_documents(cands: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JN-7 + SC-6 + FLT-5 + SC-8: documents that mention Item 5.07, with
    style attributes removed.  ``documents`` is ``(url, html)``."""
    with_url = cands.withColumn("url", keys.archive_url("cik", "accessionNumber", "primaryDocument"))
    j = text.add_clean_text(with_url.join(documents.select("url", "html"), "url", "left"), "html", "_text")
    tagged = quality.validate(j, [("document missing", F.col("html").isNotNull()),
                                  ("no item 5.07", text.mentions_item_507("_text"))]).drop("_text")
    good, bad = quality.split(tagged)
    return good.withColumn("clean_html", text.strip_style_attributes("html")).drop("html"), bad


def extract_tallies(docs: DataFrame, fn: model.ModelFn, ticker_col: str = "ticker",
                    max_concurrency: int | None = None) -> tuple[DataFrame, DataFrame]:
    """UD-1 + UD-7 + FLT-11 + AG-6: ``(tallies, rejects)``."""
    src = docs.withColumn("prompt", F.format_string(TALLY_PROMPT, F.col("clean_html"))) \
        .withColumn("meeting_date", F.date_format("group_date", "yyyy-MM-dd"))
    out = model.apply_model(src, fn, ["prompt", ticker_col, "meeting_date"],
                            ["job_id", "cik", "group_date", "accessionNumber"],
                            max_concurrency=max_concurrency)
    return tally_rows(model.parse_output(out, model.TALLY_SCHEMA))


def read_tallies(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """UD-1 without a model: the tallies that the documents' own tables show.

    As ``extract_tallies``: ``(tallies, rejects)``, the meeting date is the
    group's.  ``position`` counts a document's rows in the order of its tables.
    """
    key = ["job_id", "cik", "ticker", "meeting_date"]
    src = docs.withColumn("meeting_date", F.date_format("group_date", "yyyy-MM-dd"))
    tagged = quality.validate(src, [("ticker missing", quality.present("ticker")),
                                    ("meeting_date missing", quality.present("meeting_date"))])
    ready, skipped = quality.split(tagged)
    good, bad = vote_tables.page_tallies(ready, key, "clean_html")
    # tables and rows of one document are numbered; rows are counted in their order
    place = F.col("table_no").cast("bigint") * (1 << 32) + F.col("row_no")
    names = [F.col(c) if c != "for_votes" else F.col(c).alias("for") for c in tallies.TALLY_KINDS]
    names = [n.alias("against") if c == "against_votes" else n for n, c in zip(names, tallies.TALLY_KINDS)]
    out = good.withColumn("position", place).withColumn("raw_json", F.to_json(F.struct(
        F.col("question_id").alias("questionId"), "resolution", "total_votes", *names)))
    rejects = skipped.select("job_id", "cik", "reject_reason").unionByName(bad.select("job_id", "cik", "reject_reason"))
    return out, rejects


def tally_rows(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Validated tally rows from parsed model output (``parsed`` struct)."""
    doc_ok = quality.validate(parsed, [
        ("model error", F.col("model_error").isNull()),
        ("malformed model output", F.col("parsed").isNotNull() & F.col("parsed._corrupt_record").isNull()),
        ("ticker missing", quality.present("parsed.ticker")),
        ("meeting_date missing", quality.present("parsed.meeting_date")),
    ])
    good_docs, bad_docs = quality.split(doc_ok)
    ex = good_docs.select("job_id", "cik", F.col("parsed.ticker").alias("ticker"),
                          F.col("parsed.meeting_date").alias("meeting_date"),
                          F.posexplode("parsed.voting_results").alias("position", "v"))
    num = ("total_votes", "for", "against", "abstentions", "broker_non_votes")
    # PRJ-4: the contract's "for" becomes for_votes
    typed = ex.select(
        "job_id", "cik", "ticker", "meeting_date", "position",
        F.col("v.questionId").alias("question_id"), F.col("v.resolution").alias("resolution"),
        *[F.col(f"v.{c}").try_cast("bigint").alias(f"_{c}") for c in num],
        F.to_json("v").alias("raw_json"),
        *[F.col(f"v.{c}").alias(f"_raw_{c}") for c in num])
    # Q8: every count is nullable (null = not reported); only non-numbers are rejected
    rules = [(f"bad {c}", F.col(f"_raw_{c}").isNull() | F.col(f"_{c}").isNotNull()) for c in num]
    tagged = quality.validate(typed, [("question_id missing", quality.present("question_id")), *rules])
    good, bad = quality.split(tagged)
    out = good.select("job_id", "cik", "ticker", "meeting_date", "position", "question_id", "resolution",
                      F.col("_total_votes").alias("total_votes"), F.col("_for").alias("for_votes"),
                      F.col("_against").alias("against_votes"), F.col("_abstentions").alias("abstentions"),
                      F.col("_broker_non_votes").alias("broker_non_votes"), "raw_json")
    reason = F.when(F.col("model_error").isNotNull(), F.concat(F.lit("model error: "), F.col("model_error"))) \
        .otherwise(F.col("reject_reason"))
    rejects = bad_docs.select("job_id", "cik", reason.alias("reject_reason")).unionByName(
        bad.select("job_id", "cik", "reject_reason"))
    return tallies.with_totals(out), rejects


def store_votes(target: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SNK-4: insert-ignore by (cik, meeting_date, question_id); within a
    batch the first row in arrival order (meeting date, then position) wins."""
    b = batch.select(*VOTE_COLUMNS, "position")
    return merge.insert_ignore(target.select(*VOTE_COLUMNS), b, VOTE_KEY, ["meeting_date", "position", "raw_json"])


def vote_table(spark: SparkSession, state_dir: str) -> bucketed.BucketedTable:
    """The stored votes of a worker, dealt by company, meeting and question."""
    return bucketed.BucketedTable(spark, os.path.join(state_dir, jobs_dirs.VOTE_DIR), VOTE_KEY, VOTE_SCHEMA)


def vote_store(state_dir: str):
    """The ``store`` function for ``streaming.jobs.start_worker``: a batch's
    tallies go to the vote table (SNK-4) and, as one JSON array per job, to the
    payloads (SNK-11), each under the batch's id, so a replay stores them once."""
    def store(results: DataFrame, batch_id: int) -> None:
        votes = results.where(F.col("error").isNull())
        vote_table(results.sparkSession, state_dir).merge(
            votes.select(*VOTE_COLUMNS, "position"), batch_id, lambda old, new: store_votes(old, new)[0])
        job_payloads(votes).write.mode("overwrite").parquet(
            os.path.join(state_dir, jobs_dirs.PAYLOAD_DIR, f"batch_id={batch_id}"))
    return store


def job_payloads(tallies_df: DataFrame) -> DataFrame:
    """AG-4 + SNK-11: one JSON array of tally rows per job."""
    rows = concat.collect_rows(tallies_df, ["job_id"], ["meeting_date", "position"],
                               ["question_id", "resolution", "for_votes", "against_votes", "abstentions",
                                "broker_non_votes", "total_votes"], name="rows")
    return rows.select("job_id", F.to_json("rows").alias("result"))


def job_processor(index_rows: DataFrame, documents: DataFrame, companies: DataFrame, fn: model.ModelFn | None,
                  strict: bool = False, max_concurrency: int | None = None, bad_pages: DataFrame | None = None):
    """ST-1 + E2: the ``process`` function for ``streaming.jobs.start_worker``.

    Each micro-batch's pending jobs ``(job_id, params={"cik", "year"})`` run as
    one plan: candidates (AG-1), documents with Item 5.07, model (or, without
    ``fn``, the documents' own vote tables), validated tallies.  Returns one row per tally (``error`` null) and one row per
    failure (``error`` = reason): a company and year without an Item 5.07
    filing, a failed model call, malformed output, a bad tally.  Missing
    documents, documents without Item 5.07 and outputs without ticker or
    meeting date are skipped and leave the job ``done``.  ``bad_pages`` are
    the index rejects ``(cik, source_file, reason)``: a job of their company
    gets each as a failure, since its filings may be on them.
    """
    def process(todo: DataFrame) -> DataFrame:
        p = todo.select("job_id", F.from_json("params", "cik string, year int").alias("p"))
        jobs = p.select("job_id", F.col("p.cik").alias("cik"), F.col("p.year").alias("year"))
        cands = candidate_filings(jobs, index_rows, strict)
        docs, _skipped = filing_documents(cands, documents)
        docs = docs.join(companies.select(keys.pad_cik("cik").alias("cik"), "ticker"), "cik", "left")
        tallies_df, rejects = read_tallies(docs) if fn is None else \
            extract_tallies(docs, fn, max_concurrency=max_concurrency)
        ok = tallies_df.select("job_id", *VOTE_COLUMNS, "position", F.lit(None).cast("string").alias("error"))
        none = jobs.join(cands.select("job_id").distinct(), "job_id", "left_anti")
        if bad_pages is not None:
            pages = bad_pages.select(keys.pad_cik("cik").alias("_cik"), F.concat_ws(
                ": ", F.lit("index page"), "source_file", "reason").alias("error"))
            unread = jobs.join(pages, keys.pad_cik(jobs["cik"]) == F.col("_cik")).select(
                "job_id", F.col("_cik").alias("cik"), "error")
            none = none.join(unread.select("job_id").distinct(), "job_id", "left_anti")
        none = none.select(
            "job_id", keys.pad_cik("cik").alias("cik"),
            F.format_string("no Item 5.07 filing of %s in %d", F.col("cik"), F.col("year")).alias("error"))
        bad = none.unionByName(rejects.where(~F.col("reject_reason").isin(*SKIPPED)).select(
            "job_id", "cik", F.col("reject_reason").alias("error")))
        if bad_pages is not None:
            bad = bad.unionByName(unread)
        return ok.unionByName(bad, allowMissingColumns=True)
    return process
