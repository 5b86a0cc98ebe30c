"""Registered streaming query: the vote-extraction job queue (rows-only check).

Job requests are derived from the customer table (one job per company for a
year), written as JSON files, and drained by the Structured Streaming worker
with ``availableNow``; each job's work is the per-company filing slice of the
orders table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from filingflow.functions import keys
from filingflow.plans.catalog import register
from filingflow.session import scratch_path
from filingflow.sources.tables import read_table
from filingflow.streaming import jobs

JOB_YEAR = 1997


def _filing_slice(orders):
    def process(todo):
        p = todo.select("job_id", F.from_json("params", "cik bigint, year int").alias("p"))
        p = p.select("job_id", F.col("p.cik").alias("cik"), F.col("p.year").alias("year"))
        o = orders.select(F.col("o_custkey").alias("cik"), "o_orderkey", "o_orderdate")
        hits = p.join(o, "cik").where(F.year("o_orderdate") == F.col("year"))
        agg = hits.groupBy("job_id", "cik").agg(F.count(F.lit(1)).alias("n_filings"),
                                                F.max("o_orderdate").alias("latest_filing"))
        # jobs with no filings still report a row (n_filings = 0)
        return p.join(agg.drop("cik"), "job_id", "left").select(
            "job_id", "cik", F.coalesce("n_filings", F.lit(0)).alias("n_filings"), "latest_filing")
    return process


@register("job_queue", "ST-1 ST-2 ST-5 ST-6 SNK-9 SNK-11 SC-18", oracle="""
with req as (
  select c_custkey as cik, cast(json_object('cik', c_custkey, 'year', 1997) as varchar) as params,
         timestamp '2024-01-01 00:00:00' + to_seconds(c_custkey) as created_at
  from customer),
ids as (select cik, substr(sha256(params || '|' || cast(created_at as varchar)), 1, 32) as job_id from req),
agg as (select o_custkey as cik, count(*) as n, max(o_orderdate) as latest
        from orders where year(o_orderdate) = 1997 group by 1)
select ids.job_id, ids.cik, 'done' as status, coalesce(agg.n, 0) as n_filings,
       strftime(agg.latest, '%Y-%m-%dT%H:%M:%S') as latest_filing
from ids left join agg on agg.cik = ids.cik
""")
def job_queue(spark, d):
    base = scratch_path(spark, "job-queue")
    incoming, state = f"{base}/incoming", f"{base}/state"
    c = read_table(spark, d, "customer", "c_custkey")
    req = c.select(F.to_json(F.struct(F.col("c_custkey").alias("cik"), F.lit(JOB_YEAR).alias("year"))).alias("params"),
                   (F.lit("2024-01-01 00:00:00").cast("timestamp")
                    + F.make_interval(secs=F.col("c_custkey").cast("int"))).alias("created_at"))
    jobs.write_requests(req, incoming)
    orders = read_table(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderdate")
    q = jobs.start_worker(spark, incoming, state, _filing_slice(orders), available_now=True)
    q.awaitTermination()
    # the first micro-batch once more, as after a driver lost before its commit: nothing may change
    first = spark.read.schema(jobs.JOB_SCHEMA).json(incoming)
    jobs.make_batch_handler(state, _filing_slice(orders))(first, 0)
    res = jobs.job_results(spark, state)
    return res.select("job_id", "cik", "status", "n_filings",
                      keys.iso_timestamp("latest_filing").alias("latest_filing"))


def _counted(orders):
    """Orders of a job's company; some jobs fail once, some whenever they are tried."""
    def process(due):
        p = due.select("id", "try", F.from_json("params", "cik bigint").getField("cik").alias("cik"))
        n = orders.groupBy(F.col("o_custkey").alias("cik")).agg(F.count("*").alias("n_filings"))
        bad = ((F.col("cik") % 5 == 0) & (F.col("try") == 1)) | (F.col("cik") % 7 == 0)
        return p.join(n, "cik", "left").select("id", F.coalesce("n_filings", F.lit(0)).alias("n_filings"),
                                               F.when(bad, F.concat_ws(" ", F.lit("no answer to try"), "try")).alias("error"))
    return process


@register("job_life_cycle", "ST-1 ST-2 ST-3 ST-5 SNK-9 SNK-11 FLT-13", oracle="""
with n as (select o_custkey, count(*) as n from orders group by 1)
select 'job ' || c_custkey as id, case when c_custkey % 7 = 0 then 'failed' else 'done' end as status,
       case when c_custkey % 7 = 0 or c_custkey % 5 = 0 then 2 else 1 end as tries,
       case when c_custkey % 7 = 0 then 'no answer to try 2' end as error,
       case when c_custkey % 7 = 0 then null else coalesce(n.n, 0) end as n_filings,
       case when c_custkey % 7 = 0 then 'pending,running,error,running,failed' when c_custkey % 5 = 0 then 'pending,running,error,running,done'
            else 'pending,running,done' end as steps
from customer left join n on n.o_custkey = c_custkey
""")
def job_life_cycle(spark, d):
    """One job per company, requested twice, drained by the keyed worker: failed tries run again by timer."""
    import time

    from filingflow.streaming import lifecycle

    base = scratch_path(spark, "job-life-cycle")
    req = read_table(spark, d, "customer", "c_custkey").select(
        F.concat_ws(" ", F.lit("job"), "c_custkey").alias("id"), F.to_json(F.struct(F.col("c_custkey").alias("cik"))).alias("params"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("created_at"))
    lifecycle.request(req, base)
    lifecycle.request(req, base)
    orders = read_table(spark, d, "orders", "o_custkey")
    worker = lifecycle.start(spark, base, _counted(orders), tries=2, retry_after=0, processing_time="0 seconds")
    try:
        n = req.select("id").distinct().count()
        while worker.isActive and lifecycle.count_final(spark, base) < n:
            time.sleep(1)
    finally:
        worker.stop()
    if worker.exception():
        raise worker.exception()
    log = lifecycle.changes(spark, base)
    steps = log.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "status"))), lambda x: x["status"]), ",").alias("steps"))
    found = lifecycle.results(spark, base).select("id", F.col("n_filings").cast("bigint").alias("n_filings"))
    return lifecycle.current(spark, base).join(steps, "id").join(found, "id", "left").select(
        "id", "status", F.col("try").alias("tries"), "error", "n_filings", "steps")


# Test mapping of order status onto proxy form types.
_STATUS_TO_FORM = (("F", "DEF 14A"), ("O", "DEFR14A"), ("P", "DEFA14A"))


@register("streamed_ingest", "ST-6 SRC-1 JN-2 JN-7 FLT-3 FLT-6 SC-6 WN-5 AG-5 SNK-6", oracle="""
with f as (select o_custkey, o_orderkey from orders where o_orderstatus in ('F', 'O')),
j as (select lpad(cast(f.o_custkey as varchar), 10, '0') || '_' || cast(f.o_orderkey as varchar) as proxy_id,
             len(list_filter(regexp_split_to_array(d.text, '\\s+'), lambda x: x <> '')) as n
      from f join documents d on d.doc_id = f.o_orderkey)
select proxy_id, cast(1 + ceil(greatest(0, n - 800) / 600.0) as bigint) as n_chunks from j where n >= 500
""")
def streamed_ingest(spark, d):
    """Index pages written from the orders table are drained by the streaming
    ingest job; output: chunks per stored proxy statement."""
    from filingflow.streaming import ingest

    base = scratch_path(spark, "ingest-stream")
    o = read_table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    form = None
    for st, fm in _STATUS_TO_FORM:
        form = F.when(F.col("o_orderstatus") == st, fm) if form is None else form.when(F.col("o_orderstatus") == st, fm)
    rec = F.struct(F.col("o_orderkey").cast("string").alias("accessionNumber"),
                   F.date_format("o_orderdate", "yyyy-MM-dd").alias("filingDate"), form.alias("form"))
    # column-wise index pages of at most 1000 filings per company
    pages = o.groupBy(F.col("o_custkey").cast("string").alias("cik"),
                      F.floor(F.col("o_orderkey") / 1000).alias("page_no")).agg(F.collect_list(rec).alias("r"))

    def field(name):
        return lambda x: x[name]
    recent = F.struct(*[F.transform("r", field(c)).alias(c) for c in ("accessionNumber", "filingDate", "form")])
    pages.select("cik", F.struct(recent.alias("recent")).alias("filings")).write.json(f"{base}/index")
    # the filing documents, keyed by their archive URL
    docs = read_table(spark, d, "documents", "doc_id", "text")
    docs = o.join(docs, o.o_orderkey == docs.doc_id).select(
        keys.archive_url(keys.pad_cik("o_custkey"), F.col("o_orderkey").cast("string"),
                         keys.document_or_default(F.lit(None))).alias("url"),
        F.col("text").alias("html"))
    ingest.start(spark, f"{base}/index", f"{base}/state", docs, available_now=True,
                 multi_line=False).awaitTermination()
    filings = ingest.stored_filings(spark, f"{base}/state").select("proxy_id", "filing_id")
    counts = ingest.stored_chunks(spark, f"{base}/state").groupBy("filing_id").agg(
        F.count(F.lit(1)).alias("n_chunks"))
    return filings.join(counts, "filing_id").select("proxy_id", "n_chunks")
