"""Registered index / selection queries: column-wise pages, filters, latest per
group, top-n, first match, directory join, key building, diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from filingflow.functions import forms, keys
from filingflow.operators import latest, quality, ranking
from filingflow.plans.catalog import register
from filingflow.sources import directory, filing_index
from filingflow.sources.tables import read_table

# Orders stand in for filings: o_custkey = company, o_orderkey = accession,
# o_orderdate = filing / meeting date, o_orderstatus = form, priority = items.


@register("columnar_to_rows", "SRC-1 AG-7 PRJ-1 SO-1", oracle="""
select o_custkey as cik, cast(o_orderkey as varchar) as accessionNumber,
       strftime(o_orderdate, '%Y-%m-%d') as filingDate, o_orderstatus as form,
       o_orderpriority as items, 'primary_doc.htm' as primaryDocument
from orders
""")
def columnar_to_rows(spark, d):
    o = read_table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus",
                   "o_orderpriority", "o_orderdate")
    rec = F.struct(o.o_orderkey.cast("string").alias("accessionNumber"),
                   F.date_format("o_orderdate", "yyyy-MM-dd").alias("filingDate"),
                   F.col("o_orderstatus").alias("form"), F.col("o_orderpriority").alias("items"))
    # column-wise index pages of at most 1000 filings per company (bounded
    # groups, like the paged index files)
    recs = o.groupBy(F.col("o_custkey").alias("cik"),
                     F.floor(F.col("o_orderkey") / 1000).alias("page_no")).agg(F.collect_list(rec).alias("r"))
    null_col = F.lit(None).cast(ArrayType(StringType()))
    def field(name):
        return lambda x: x[name]
    page = F.struct(*[
        (F.transform("r", field(c)) if c in ("accessionNumber", "filingDate", "form", "items")
         else null_col).alias(c) for c in filing_index.INDEX_COLUMNS])
    rows, _rejects = filing_index.index_rows(recs.select("cik", "page_no", page.alias("page")),
                                            ["cik", "page_no"])
    rows = filing_index.normalise(rows)
    return rows.select("cik", "accessionNumber", "filingDate", "form", "items", "primaryDocument")


@register("index_filter", "FLT-1 FLT-3", oracle="""
select o_orderkey, o_custkey, o_orderpriority from orders
where o_orderdate >= date '1997-01-01' and o_orderdate < date '1998-01-01'
  and regexp_matches(o_orderpriority, '(?i)^[12]-(URGENT|HIGH)$')
""")
def index_filter(spark, d):
    o = read_table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    cond = keys.year_range("o_orderdate", 1997) & forms.form_matches("o_orderpriority", r"^[12]-(URGENT|HIGH)$")
    return o.where(cond).select("o_orderkey", "o_custkey", "o_orderpriority")


@register("contains_null_false", "FLT-2 FLT-4", oracle="""
select p_partkey,
       coalesce(regexp_matches(nullif(p_type, 'PROMO'), '(?i)AR|eco'), false) as matches_form,
       coalesce(contains(nullif(p_brand, 'Brand#1'), '#1'), false) as has_item
from part
""")
def contains_null_false(spark, d):
    p = read_table(spark, d, "part", "p_partkey", "p_type", "p_brand")
    return p.select("p_partkey",
                    forms.form_matches(F.nullif("p_type", F.lit("PROMO")), "AR|eco").alias("matches_form"),
                    forms.items_include(F.nullif("p_brand", F.lit("Brand#1")), "#1").alias("has_item"))


@register("latest_nonnull_per_group", "AG-1 SL-1", oracle="""
select o_custkey,
  arg_max(st, acc) filter (where st is not null) as status,
  arg_max(pr, acc) filter (where pr is not null) as priority,
  arg_max(o_totalprice, acc) filter (where o_totalprice is not null) as o_totalprice
from (select o_custkey, cast(o_orderkey as varchar) as acc, nullif(o_orderstatus, 'P') as st,
             nullif(o_orderpriority, '5-LOW') as pr, o_totalprice from orders)
group by o_custkey
""")
def latest_nonnull_per_group(spark, d):
    o = read_table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus",
                   "o_orderpriority", "o_totalprice")
    src = o.select("o_custkey", o.o_orderkey.cast("string").alias("acc"),
                   F.nullif("o_orderstatus", F.lit("P")).alias("status"),
                   F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"), "o_totalprice")
    return latest.latest_nonnull(src, ["o_custkey"], "acc", ["status", "priority", "o_totalprice"])


@register("latest_strict_per_group", "AG-1 SL-1", oracle="""
select o_custkey, o_orderkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') as filing_date
from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) rn
      from orders) where rn = 1
""")
def latest_strict_per_group(spark, d):
    o = read_table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus",
                   "o_totalprice", "o_orderdate")
    best = latest.latest_whole_row(o, ["o_custkey"], ["o_orderdate", "o_orderkey"],
                                   ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"])
    return best.select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice",
                       F.date_format("o_orderdate", "yyyy-MM-dd").alias("filing_date"))


@register("newest_n_per_security", "WN-1 SL-4", oracle="""
select o_custkey, o_orderkey, rank from (
  select o_custkey, o_orderkey,
         row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as rank
  from orders) where rank <= 5
""")
def newest_n_per_security(spark, d):
    o = read_table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    top = ranking.top_n_per_group(o, ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")], 5)
    return top.select("o_custkey", "o_orderkey", F.col("rank").cast("bigint").alias("rank"))


@register("first_match", "WN-2", oracle="""
select user_id, event_id from (
  select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) rn
  from events where event_type = 'purchase') where rn = 1
""")
def first_match(spark, d):
    e = read_table(spark, d, "events", "event_id", "user_id", "event_type", "ts")
    m = e.where(F.col("event_type") == "purchase")
    return ranking.first_per_group(m, ["user_id"], [F.asc("ts"), F.asc("event_id")]).select("user_id", "event_id")


@register("explicit_ids_or_top_n", "JN-6 WN-1", oracle="""
with ex as (
  select distinct c.c_custkey, o.o_orderkey from customer c join orders o on o.o_custkey = c.c_custkey
  where c.c_mktsegment = 'BUILDING' and o.o_orderpriority = '1-URGENT'),
cand as (
  select o.o_custkey as c_custkey, o.o_orderkey,
         row_number() over (partition by o.o_custkey order by o.o_orderdate desc, o.o_orderkey) as rk
  from orders o join customer c on c.c_custkey = o.o_custkey
  where o.o_custkey not in (select c_custkey from ex))
select c_custkey, o_orderkey, 'explicit' as source from ex
union all
select c_custkey, o_orderkey, 'top_n' as source from cand where rk <= 3
""")
def explicit_ids_or_top_n(spark, d):
    c = read_table(spark, d, "customer", "c_custkey", "c_mktsegment")
    o = read_table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    requests = c.select("c_custkey", F.lit(3).alias("n"))
    explicit = (c.where(F.col("c_mktsegment") == "BUILDING")
                .join(o.where(F.col("o_orderpriority") == "1-URGENT")
                      .withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")
                .select("c_custkey", "o_orderkey"))
    cand = o.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")
    return ranking.explicit_ids_or_top_n(requests, cand, explicit, ["c_custkey"], "o_orderkey",
                                         [F.desc("o_orderdate"), F.asc("o_orderkey")])


@register("directory_left_join", "JN-1 SC-1 SRC-3", oracle="""
with dir as (
  select lpad(cast(s_nationkey as varchar), 10, '0') as cik, arg_max(s_name, s_suppkey) as company_name
  from supplier where s_acctbal > 0 group by 1)
select c.c_custkey,
       case when length(cast(c.c_nationkey as varchar)) < 10 then lpad(cast(c.c_nationkey as varchar), 10, '0')
            else cast(c.c_nationkey as varchar) end as cik,
       d.company_name
from customer c left join dir d
  on d.cik = case when length(cast(c.c_nationkey as varchar)) < 10
                  then lpad(cast(c.c_nationkey as varchar), 10, '0') else cast(c.c_nationkey as varchar) end
""")
def directory_left_join(spark, d):
    s = read_table(spark, d, "supplier", "s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    entries = s.where(F.col("s_acctbal") > 0).select(
        keys.pad_cik("s_nationkey").alias("cik"), F.col("s_name").alias("company_name"), "s_suppkey")
    dir_ = directory.last_entry_per_cik(entries, "cik", ["s_suppkey"], ["company_name"])
    c = read_table(spark, d, "customer", "c_custkey", "c_nationkey")
    joined = directory.with_company(c.withColumn("cik", keys.pad_cik("c_nationkey")), dir_, "cik")
    return joined.select("c_custkey", "cik", "company_name")


@register("pending_questions", "JN-3 FLT-8 SC-5 ST-3 PRJ-4", oracle="""
with log as (select user_id as k, event_type as t, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events),
cur as (select k, case when t in ('purchase', 'click') then 'DONE' else 'ERROR' end as status from log where rn = 1),
q as (select l.l_orderkey as filing_id, cast(l.l_linenumber as varchar) as question_id, l.l_returnflag as proxy_question,
             coalesce(cur.status, 'NEW') as status
      from lineitem l left join cur on cur.k = l.l_orderkey)
select q.filing_id, q.question_id, q.proxy_question, q.status, c.c_name as company_name,
       strftime(o.o_orderdate, '%B %d %Y') as meeting_date_text
from q join orders o on o.o_orderkey = q.filing_id join customer c on c.c_custkey = o.o_custkey
where q.status in ('NEW', 'ERROR')
""")
def pending_questions(spark, d):
    """Questions (order lines) whose latest status is not DONE, however often
    they failed, with their filing; the event log is the status log."""
    from filingflow.plans import recommendation
    li = read_table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag")
    questions = li.select(F.col("l_orderkey").alias("filing_id"), F.col("l_linenumber").cast("string").alias("question_id"),
                          F.col("l_returnflag").alias("question_text"), F.lit("NEW").alias("status"))
    o = read_table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    c = read_table(spark, d, "customer", "c_custkey", "c_name")
    filings = o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("filing_id"), F.col("c_name").alias("company_name"), F.col("o_orderdate").alias("filing_date"))
    e = read_table(spark, d, "events", "event_id", "user_id", "event_type", "ts")
    done = F.col("event_type").isin("purchase", "click")
    # a log entry holds for all questions of its filing: the latest per filing first, then its questions
    log = e.select(F.col("user_id").alias("filing_id"), F.when(done, "DONE").otherwise("ERROR").alias("status"),
                   F.struct("ts", "event_id").alias("seq"))
    log = log.groupBy("filing_id").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))
    log = questions.select("filing_id", "question_id").join(log, "filing_id")
    got = recommendation.pending_questions(questions, filings, log)
    return got.select("filing_id", "question_id", "proxy_question", "status", "company_name", "meeting_date_text")


@register("oldest_pending", "SL-2", oracle="""
select o_orderkey, o_custkey from orders where o_orderstatus = 'O'
order by o_orderdate, o_orderkey limit 1
""")
def oldest_pending(spark, d):
    o = read_table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    return ranking.oldest(o.where(F.col("o_orderstatus") == "O"),
                          [F.asc("o_orderdate"), F.asc("o_orderkey")], 1).select("o_orderkey", "o_custkey")


# Test mapping of the six part types onto form codes.
_TYPE_TO_FORM = (("LARGE", "DEF 14A"), ("MEDIUM", "DEFR14A"), ("PROMO", "defa14a"),
                 ("STANDARD", "DEFC14A"), ("SMALL", "PREC 14A"), ("ECONOMY", "10-K"))


@register("form_class", "PRJ-6 SC-3", oracle="""
with f as (select p_partkey, case p_type """ + " ".join(f"when '{a}' then '{b}'" for a, b in _TYPE_TO_FORM) + """ end as form
           from part)
select p_partkey, form,
  case when upper(replace(form, ' ', '')) = 'DEF14A' then 'proxy_statement'
       when upper(replace(form, ' ', '')) = 'DEFR14A' then 'proxy_statement'
       when upper(replace(form, ' ', '')) = 'DEFA14A' then 'proxy_supplement'
       when upper(replace(form, ' ', '')) in ('DEFC14A', 'PREC14A', 'PRRN14A') then 'contestant_proxy'
       else 'other' end as doc_class,
  case when upper(replace(form, ' ', '')) = 'DEF14A' then 'original'
       when upper(replace(form, ' ', '')) = 'DEFR14A' then 'revision'
       when upper(replace(form, ' ', '')) = 'DEFA14A' then 'supplement'
       when upper(replace(form, ' ', '')) in ('DEFC14A', 'PREC14A', 'PRRN14A') then 'original'
       else 'other' end as revision
from f
""")
def form_class(spark, d):
    p = read_table(spark, d, "part", "p_partkey", "p_type")
    m = None
    for a, b in _TYPE_TO_FORM:
        m = F.when(F.col("p_type") == a, F.lit(b)) if m is None else m.when(F.col("p_type") == a, F.lit(b))
    f = p.select("p_partkey", m.alias("form"))
    return f.select("p_partkey", "form", forms.form_class("form").alias("c")) \
        .select("p_partkey", "form", "c.doc_class", "c.revision")


@register("archive_key", "PRJ-2 PRJ-3 SC-1 SC-2", oracle="""
with a as (
  select o_orderkey, lpad(cast(o_custkey as varchar), 10, '0') as cik,
         lpad(cast(o_custkey as varchar), 10, '0') || '-' || strftime(o_orderdate, '%y') || '-' ||
         case when length(cast(o_orderkey as varchar)) < 6 then lpad(cast(o_orderkey as varchar), 6, '0')
              else cast(o_orderkey as varchar) end as accession
  from orders)
select o_orderkey, cik || '_' || accession as proxy_id,
       'https://www.sec.gov/Archives/edgar/data/' || cast(cast(cik as bigint) as varchar) || '/' ||
       replace(accession, '-', '') || '/' || 'primary_doc.htm' as url
from a
""")
def archive_key(spark, d):
    o = read_table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    seq = o.o_orderkey.cast("string")
    acc = F.concat_ws("-", keys.pad_cik("o_custkey"), F.date_format("o_orderdate", "yy"),
                      F.when(F.length(seq) < 6, F.lpad(seq, 6, "0")).otherwise(seq))
    a = o.select("o_orderkey", keys.pad_cik("o_custkey").alias("cik"), acc.alias("accession"),
                 F.lit(None).cast("string").alias("doc"))
    return a.select("o_orderkey", keys.proxy_id("cik", "accession").alias("proxy_id"),
                    keys.archive_url("cik", "accession", keys.document_or_default("doc")).alias("url"))


@register("missing_diagnostics", "FLT-14 JN-2", oracle="""
select c_custkey, 'no filings for year 2001' as reason from customer
where c_custkey not in (select o_custkey from orders
                        where o_orderdate >= date '2001-01-01' and o_orderdate < date '2002-01-01')
""")
def missing_diagnostics(spark, d):
    c = read_table(spark, d, "customer", "c_custkey")
    o = read_table(spark, d, "orders", "o_custkey", "o_orderdate")
    hits = o.where(keys.year_range("o_orderdate", 2001)).select(F.col("o_custkey").alias("c_custkey"))
    return quality.diagnostics(c, hits, ["c_custkey"], "no filings for year 2001")


@register("union_by_name", "SO-1", oracle="""
select o_orderkey, o_custkey, o_orderpriority, o_orderstatus from orders where o_orderdate < date '1998-01-01'
union all
select o_orderkey, o_custkey, null as o_orderpriority, o_orderstatus from orders where o_orderdate >= date '1998-01-01'
""")
def union_by_name(spark, d):
    o = read_table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus",
                   "o_orderdate")
    cut = F.lit("1998-01-01").cast("date")
    older = o.where(F.col("o_orderdate") < cut).select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    newer = o.where(F.col("o_orderdate") >= cut).select("o_orderstatus", "o_orderkey", "o_custkey")
    return filing_index.union_pages(older, newer)


@register("filing_year_text", "SC-4 PRJ-7", oracle="""
select o_orderkey, cast(substr(strftime(o_orderdate, '%Y-%m-%d'), 1, 4) as integer) as filing_year,
       strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as filed_at
from orders
""")
def filing_year_text(spark, d):
    o = read_table(spark, d, "orders", "o_orderkey", "o_orderdate")
    return o.select("o_orderkey", keys.year_of_text(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("filing_year"),
                    keys.iso_timestamp("o_orderdate").alias("filed_at"))


@register("page_pruning", "SRC-2 SC-4", oracle="""
select cik, page_no from (
  select o_custkey as cik, o_orderkey // 1000 as page_no,
         strftime(min(o_orderdate), '%Y-%m-%d') as f, strftime(max(o_orderdate), '%Y-%m-%d') as t
  from orders group by 1, 2)
where cast(substr(f, 1, 4) as integer) <= 1997 and cast(substr(t, 1, 4) as integer) >= 1997
""")
def page_pruning(spark, d):
    o = read_table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    # index pages of at most 1000 filings per company and their date spans
    pages = o.groupBy(F.col("o_custkey").alias("cik"), F.floor(F.col("o_orderkey") / 1000).alias("page_no")).agg(
        F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("filingFrom"),
        F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("filingTo"))
    refs = pages.select("cik", F.array(F.struct(F.col("page_no").alias("name"), "filingFrom", "filingTo"))
                        .alias("files"))
    kept = filing_index.older_pages_for_year(refs, ["cik"], 1997)
    return kept.select("cik", F.col("name").alias("page_no"))


@register("filing_documents", "JN-7 PRJ-5 PRJ-2 PRJ-3 FLT-6 SC-1", oracle="""
select lpad(cast(o.o_custkey as varchar), 10, '0') || '_' || cast(o.o_orderkey as varchar) as proxy_id,
       'https://www.sec.gov/Archives/edgar/data/' || cast(o.o_custkey as varchar) || '/' ||
       cast(o.o_orderkey as varchar) || '/primary_doc.htm' as url,
       cast(len(regexp_extract_all(d.text, '\\S+')) as bigint) as n_words
from orders o join documents d on d.doc_id = o.o_orderkey
where len(regexp_extract_all(d.text, '\\S+')) >= 500
""")
def filing_documents(spark, d):
    from filingflow.functions import text as T
    from filingflow.operators.parallel import by_setting
    o = read_table(spark, d, "orders", "o_orderkey", "o_custkey")
    idx = o.select(keys.pad_cik("o_custkey").alias("cik"), o.o_orderkey.cast("string").alias("acc"))
    filings = idx.select(keys.proxy_id("cik", "acc").alias("proxy_id"),
                         keys.archive_url("cik", "acc", keys.document_or_default(F.lit(None))).alias("url"), "acc")
    docs = by_setting(read_table(spark, d, "documents", "doc_id", "text"), ["doc_id"]) \
        .select(F.col("doc_id").cast("string").alias("acc"), "text")
    # JN-7: filings without a document are dropped; FLT-6 keeps long texts
    j = filings.join(docs, "acc").where(T.has_min_words("text", 500))
    return j.select("proxy_id", "url", T.word_count("text").cast("bigint").alias("n_words"))
