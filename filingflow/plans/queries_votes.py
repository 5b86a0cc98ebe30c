"""Registered queries over vote tables in pages and over meeting feeds (E2, E3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from filingflow.operators import vote_tables
from filingflow.operators.parallel import by_setting
from filingflow.plans import meeting_fetch
from filingflow.plans.catalog import register
from filingflow.session import scratch_path
from filingflow.sources import meetings
from filingflow.sources.tables import read_table

# One page for the lines of an order (at most 50 a page): header over two rows, spanned columns,
# a column that spans all rows, dashes for counts not reported, a layout table around it, and a
# line whose count is no number.
_HEADER = ('<html><body><table><tr><td>For the record <b>Against</b> 5.07<p>'
           '<table><tr><th rowspan=2>Proposal<th colspan="4" title="a > b">Votes&nbsp;cast</th>'
           '<th rowspan=2>Broker<br>Non-Votes</th></tr><tr><th>For</th><th>Against<th colspan=2>Abstentions</tr>')


@register("vote_tables", "UD-1 AG-6 PRJ-4", oracle="""
with l as (
  select l_orderkey, l_linenumber // 50 as page_no, l_returnflag, l_partkey, l_suppkey, l_linenumber,
         cast(l_quantity * 1000 as bigint) as f,
         row_number() over (partition by l_orderkey, l_linenumber // 50
                            order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) as pos
  from lineitem)
select l_orderkey as filing_id, page_no, 1 as table_no, cast(pos as int) as row_no,
       cast(l_linenumber as varchar) as question_id, 'Proposal ' || l_linenumber || ': "a > b" & ' || l_returnflag as resolution,
       f as for_votes, case when l_returnflag <> 'A' then l_partkey end as against_votes,
       case when l_returnflag = 'N' then null when l_suppkey % 10 <> 0 then l_suppkey end as abstentions,
       l_orderkey as broker_non_votes,
       case when l_returnflag = 'R' and l_suppkey % 10 <> 0 then f + l_partkey + l_suppkey + l_orderkey end as total_votes,
       case when l_suppkey % 10 = 0 and l_returnflag <> 'N' then 'bad abstentions' end as reject_reason
from l
""")
def vote_tables_query(spark, d):
    """Pages with the lines of orders as proposals, read back from their markup."""
    li = read_table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    key = [F.col("l_orderkey").alias("filing_id"), F.expr("l_linenumber div 50").alias("page_no")]
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    pages = li.groupBy(*key).agg(F.sort_array(F.collect_list(line)).alias("lines"))

    def row(x, i):
        flag = x["l_returnflag"]
        shown = F.when(flag == "N", "&mdash;").when(x["l_suppkey"] % 10 == 0, F.concat(x["l_suppkey"], F.lit(" or so"))) \
            .otherwise(F.concat(x["l_suppkey"], F.lit(" (1)")))
        return F.concat(
            F.lit("<tr><td>Proposal "), x["l_linenumber"], F.lit(': "a &gt; b" &amp; <i>'), flag, F.lit("</i></td><td>"),
            F.format_number((x["l_quantity"] * 1000).cast("bigint"), 0), F.lit("<td>"),
            F.when(flag == "A", "N/A").otherwise(x["l_partkey"].cast("string")),
            F.lit("</td><td colspan=2>"), shown, F.lit("</td>"),
            F.when(i == 0, F.concat(F.lit("<td rowspan=0>"), F.format_number("filing_id", 0), F.lit("</td>"))).otherwise(""))
    html = F.concat(F.lit(_HEADER), F.array_join(F.transform("lines", row), ""), F.lit("</table></table>"))
    src = by_setting(pages.select("filing_id", "page_no", html.alias("html")), ["filing_id", "page_no"])
    return vote_tables.tagged_tallies(src, ["filing_id", "page_no"]).select(
        "filing_id", "page_no", "table_no", "row_no", "question_id", "resolution", "for_votes", "against_votes",
        "abstentions", "broker_non_votes", "total_votes", "reject_reason")


# Feeds: four customers' orders of one range of 4,000 order keys are one ticker's feed, two customers
# share an ISIN (the first in the feed counts); orders are the meetings.
_FEED_SQL = """
with o as (select *, 'T' || (o_custkey // 4) || '-' || (o_orderkey // 4000) as ticker, 'I' || (o_custkey // 2) as isin from orders),
firsts as (select ticker, isin, min(o_custkey) as o_custkey from o group by all),
feed as (select o.* from o join firsts using (ticker, isin, o_custkey)),
req as (
  select distinct o_custkey || '-' || (o_orderkey // 4000) as request_id, o_custkey, o_orderkey // 4000 as page_no,
         case when c_mktsegment = 'HOUSEHOLD' and c_nationkey % 5 = 0 then 'X' || o_custkey else ticker end as ticker,
         case when c_mktsegment = 'MACHINERY' then null when c_mktsegment = 'FURNITURE' then 'J' || o_custkey else isin end as isin,
         case when c_acctbal < 0 then 0 when c_mktsegment = 'BUILDING' then null else 1 + c_nationkey % 4 end as n,
         c_mktsegment
  from o join customer on c_custkey = o_custkey),
good as (select *, coalesce(n, 5) as want from req where isin is not null and coalesce(n, 1) >= 1),
listed as (
  select request_id, cast(o_orderkey as varchar) as meeting_id, strftime(o_orderdate, '%Y-%m-%d') as meeting_date, rk, want from (
    select g.request_id, f.o_orderkey, f.o_orderdate, g.want,
           row_number() over (partition by g.request_id order by f.o_orderdate desc, f.o_orderkey) as rk
    from good g join feed f on f.ticker = g.ticker and f.isin = g.isin) where rk <= want),
bad as (
  select request_id, case when isin is null then 'isin is required' else 'n must be at least 1' end as reason
  from req where isin is null or coalesce(n, 1) < 1),
"""


def _feed_and_requests(spark, d):
    """Feed files (written as JSON lines, then read as feeds) and one request per customer and range of orders."""
    o = read_table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate").withColumn("page_no", F.expr("o_orderkey div 4000"))
    ticker = F.concat(F.lit("T"), F.expr("o_custkey div 4"), F.lit("-"), "page_no")
    isin = F.concat(F.lit("I"), F.expr("o_custkey div 2"))
    # dealt by ticker, which customer and page determine: both groupings need no other shuffle
    lines = o.select(ticker.alias("ticker"), "o_custkey", "page_no", F.struct(
        "o_orderkey", "o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).alias("line")).repartition("ticker")
    m = lines.groupBy("ticker", "o_custkey", "page_no").agg(F.transform(
        F.sort_array(F.collect_list("line")),
        lambda x: F.struct(x["o_orderkey"].cast("string").alias("meetingId"), x["day"].alias("meetingDate"))).alias("meetings"))
    feed = m.groupBy("ticker").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("o_custkey", isin.alias("isin"), "meetings"))),
        lambda x: F.struct(x["isin"].alias("isin"), x["meetings"].alias("meetings"))).alias("companies"))
    path = scratch_path(spark, "meeting-feeds")
    feed.write.json(path)
    c = read_table(spark, d, "customer", "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    r = o.select("o_custkey", "page_no").distinct().join(c, F.col("o_custkey") == F.col("c_custkey"))
    seg = F.col("c_mktsegment")
    requests = r.select(
        F.concat_ws("-", "o_custkey", "page_no").alias("request_id"), "o_custkey", "page_no", "c_mktsegment",
        F.when((seg == "HOUSEHOLD") & (F.col("c_nationkey") % 5 == 0), F.concat(F.lit("X"), "o_custkey"))
        .otherwise(ticker).alias("ticker"),
        F.when(seg == "MACHINERY", None).when(seg == "FURNITURE", F.concat(F.lit("J"), "o_custkey")).otherwise(isin).alias("isin"),
        F.when(F.col("c_acctbal") < 0, 0).when(seg == "BUILDING", None).otherwise(1 + F.col("c_nationkey") % 4)
        .cast("int").alias("n"))
    return meetings.read_feed(spark, path, lines=True), requests


@register("meeting_list", "SRC-4 FLT-9 FLT-11 FLT-14 WN-1 WN-2", oracle=_FEED_SQL + """
known as (select distinct ticker from o)
select request_id, meeting_id, meeting_date, cast(rk as int) as rank, cast(null as varchar) as reason from listed
union all
select request_id, null, null, null, reason from bad
union all
select request_id, null, null, null, case when ticker in (select ticker from known)
       then 'No company of ticker ''' || ticker || ''' has the ISIN ''' || isin || ''''
       else 'No feed for ticker ''' || ticker || '''' end
from good where request_id not in (select request_id from listed)
""")
def meeting_list(spark, d):
    feed, requests = _feed_and_requests(spark, d)
    good, bad = meetings.validate_requests(requests.select("request_id", "ticker", "isin", "n"))
    found, diag = meetings.list_meetings(good, meetings.feed_rows(feed))
    out = found.select("request_id", "meeting_id", "meeting_date", "rank")
    return out.unionByName(diag.select("request_id", "reason"), allowMissingColumns=True).unionByName(
        bad.select("request_id", F.col("reject_reason").alias("reason")), allowMissingColumns=True)


@register("meeting_documents", "FLT-10 FLT-11 FLT-14 JN-6 JN-7", oracle=_FEED_SQL + """
ids as (
  select g.request_id, cast(x.o_orderkey as varchar) as meeting_id
  from good g join orders x on x.o_custkey = g.o_custkey and x.o_orderkey // 4000 = g.page_no
  where g.c_mktsegment = 'AUTOMOBILE' and x.o_orderpriority = '1-URGENT'),
chosen as (
  select * from ids union all
  select request_id, meeting_id from listed where request_id not in (select request_id from ids)),
docs as (select cast(o_orderkey as varchar) as meeting_id, o_orderstatus as st from orders where o_orderpriority <> '5-LOW'),
got as (select c.request_id, c.meeting_id, d.st from chosen c left join docs d using (meeting_id))
select request_id, meeting_id, case st when 'F' then '{"status":"warning","message":"Late"}'
       else '{"status":"ok","meeting":"' || meeting_id || '"}' end as payload, cast(null as varchar) as reason
from got where st is not null and st <> 'P'
union all
select request_id, null, null, case when st is null then 'document missing: ' else 'not found / warning payload: ' end || meeting_id
from got where st is null or st = 'P'
union all
select request_id, null, null, 'no meetings found' from good where request_id not in (select request_id from chosen)
union all
select request_id, null, null, reason from bad
""")
def meeting_documents(spark, d):
    feed, requests = _feed_and_requests(spark, d)
    o = read_table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    asking = read_table(spark, d, "customer", "c_custkey", "c_mktsegment").where(F.col("c_mktsegment") == "AUTOMOBILE")
    urgent = o.where(F.col("o_orderpriority") == "1-URGENT").join(asking, F.col("o_custkey") == F.col("c_custkey"), "left_semi") \
        .groupBy("o_custkey", F.expr("o_orderkey div 4000").alias("page_no")).agg(F.collect_list(F.col("o_orderkey").cast("string")).alias("ids"))
    requests = requests.join(urgent, ["o_custkey", "page_no"], "left").select(
        "request_id", "ticker", "isin", "n", F.when(F.col("c_mktsegment") == "AUTOMOBILE", F.col("ids")).alias("meeting_ids"))
    key = F.col("o_orderkey").cast("string")
    payload = F.when(F.col("o_orderstatus") == "P", '{"status":"warning","message":"Not found"}') \
        .when(F.col("o_orderstatus") == "F", '{"status":"warning","message":"Late"}') \
        .otherwise(F.concat(F.lit('{"status":"ok","meeting":"'), key, F.lit('"}')))
    docs = o.where(F.col("o_orderpriority") != "5-LOW").select(key.alias("meeting_id"), payload.alias("payload"))
    got, diag = meeting_fetch.fetch(requests, feed, docs)
    return got.select("request_id", "meeting_id", "payload").unionByName(diag, allowMissingColumns=True)
