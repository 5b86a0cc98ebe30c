"""Registered merge / status / tally / validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from filingflow.functions import json_fields, text
from filingflow.operators import merge, quality, status, tallies
from filingflow.plans.catalog import register
from filingflow.sources.tables import read_table


@register("skip_ingested", "JN-2 SO-2 ST-6", oracle="""
select o_orderkey, o_custkey from orders o
where not exists (select 1 from orders d where d.o_orderstatus = 'F' and d.o_orderkey = o.o_orderkey)
""")
def skip_ingested(spark, d):
    o = read_table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    done = o.where(F.col("o_orderstatus") == "F").select("o_orderkey")
    return merge.skip_done(o.select("o_orderkey", "o_custkey"), done, ["o_orderkey"])


@register("insert_ignore", "SNK-4 JN-4", oracle="""
with t as (select o_custkey, strftime(o_orderdate, '%Y-%m-%d') as day, o_orderkey
           from orders where o_orderstatus = 'F'),
b as (select o_custkey, strftime(o_orderdate, '%Y-%m-%d') as day, o_orderkey,
             row_number() over (partition by o_custkey, strftime(o_orderdate, '%Y-%m-%d') order by o_orderkey) rn
      from orders where o_orderstatus in ('O', 'P'))
select o_custkey, day, o_orderkey from t
union all
select o_custkey, day, o_orderkey from b
where rn = 1 and not exists (select 1 from t where t.o_custkey = b.o_custkey and t.day = b.day)
""")
def insert_ignore(spark, d):
    o = read_table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    rows = o.select("o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
                    "o_orderkey", "o_orderstatus")
    target = rows.where(F.col("o_orderstatus") == "F").drop("o_orderstatus")
    batch = rows.where(F.col("o_orderstatus").isin("O", "P")).drop("o_orderstatus")
    merged, _ = merge.insert_ignore(target, batch, ["o_custkey", "day"], ["o_orderkey"])
    return merged


_UPSERT_SQL = """
with t as (select o_orderkey, o_totalprice, o_orderpriority, o_orderstatus
           from orders where o_orderstatus in ('F', 'O')),
b as (select o_orderkey, o_totalprice + 1 as o_totalprice, nullif(o_orderpriority, '5-LOW') as o_orderpriority,
             o_orderstatus from orders where o_orderstatus in ('O', 'P'))
select coalesce(b.o_orderkey, t.o_orderkey) as o_orderkey,
       case when b.o_orderkey is not null then b.o_totalprice else t.o_totalprice end as o_totalprice,
       case when b.o_orderkey is not null then {priority} else t.o_orderpriority end as o_orderpriority,
       case when b.o_orderkey is not null then b.o_orderstatus else t.o_orderstatus end as o_orderstatus
from t full outer join b on t.o_orderkey = b.o_orderkey
"""


def _upsert(spark, d, priority_rule):
    o = read_table(spark, d, "orders", "o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    target = o.where(F.col("o_orderstatus").isin("F", "O"))
    batch = o.where(F.col("o_orderstatus").isin("O", "P")).select(
        "o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"),
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("o_orderpriority"), "o_orderstatus")
    rules = {"o_totalprice": merge.REPLACE, "o_orderpriority": priority_rule, "o_orderstatus": merge.REPLACE}
    return merge.upsert(target, batch, ["o_orderkey"], rules)


@register("upsert_replace", "SNK-5 JN-8", oracle=_UPSERT_SQL.format(priority="b.o_orderpriority"))
def upsert_replace(spark, d):
    return _upsert(spark, d, merge.REPLACE)


@register("upsert_keep_old", "SNK-7 JN-8", oracle=_UPSERT_SQL.format(
    priority="coalesce(b.o_orderpriority, t.o_orderpriority)"))
def upsert_keep_old(spark, d):
    return _upsert(spark, d, merge.KEEP_IF_NULL)


@register("replace_by_key", "SNK-6 SNK-10", oracle="""
select l_orderkey, l_linenumber, l_quantity from lineitem
where l_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')
union all
select l_orderkey, l_linenumber, l_quantity + 100 as l_quantity from lineitem where l_returnflag = 'R'
""")
def replace_by_key(spark, d):
    li = read_table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    target = li.select("l_orderkey", "l_linenumber", "l_quantity")
    batch = li.where(F.col("l_returnflag") == "R").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") + 100).alias("l_quantity"))
    return merge.replace_by_key(target, batch, ["l_orderkey"])


@register("latest_status", "SNK-9 ST-2 ST-3", oracle="""
select user_id, event_type as status, event_id as last_event_id from (
  select user_id, event_type, event_id,
         row_number() over (partition by user_id order by ts desc, event_id desc) rn from events)
where rn = 1
""")
def latest_status(spark, d):
    e = read_table(spark, d, "events", "event_id", "user_id", "event_type", "ts")
    cur = status.current_status(e.withColumnRenamed("event_type", "status")
                                .withColumn("last_event_id", F.col("event_id")),
                                ["user_id"], ["ts", "event_id"], ["status", "last_event_id"])
    return cur


# Events stand in for tallies: per (user, day) each event type is one vote kind.
_KIND_OF_TYPE = (("click", "for_votes"), ("view", "against_votes"),
                 ("purchase", "abstentions"), ("error", "broker_non_votes"))


@register("vote_totals", "AG-6", oracle="""
with v as (
  select user_id, strftime(ts, '%Y-%m-%d') as day, event_type, cast(round(value * 100) as bigint) as n from events)
select user_id, day,
  sum(n) filter (where event_type = 'click') as for_votes,
  sum(n) filter (where event_type = 'view') as against_votes,
  sum(n) filter (where event_type = 'purchase') as abstentions,
  sum(n) filter (where event_type = 'error') as broker_non_votes,
  coalesce(sum(n) filter (where event_type = 'signup'),
           sum(n) filter (where event_type = 'click') + sum(n) filter (where event_type = 'view') +
           sum(n) filter (where event_type = 'purchase') + sum(n) filter (where event_type = 'error')) as total_votes,
  sum(n) filter (where event_type = 'click') + sum(n) filter (where event_type = 'view') +
  sum(n) filter (where event_type = 'purchase') + sum(n) filter (where event_type = 'error') as computed_total,
  coalesce(sum(n) filter (where event_type = 'signup') <>
           (sum(n) filter (where event_type = 'click') + sum(n) filter (where event_type = 'view') +
            sum(n) filter (where event_type = 'purchase') + sum(n) filter (where event_type = 'error')), false)
    as total_mismatch
from v group by user_id, day
""")
def vote_totals(spark, d):
    e = read_table(spark, d, "events", "user_id", "ts", "event_type", "value")
    v = e.select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type",
                 F.round(F.col("value") * 100).cast("bigint").alias("n"))
    aggs = [F.sum(F.when(F.col("event_type") == t, F.col("n"))).alias(k) for t, k in _KIND_OF_TYPE]
    # a stated total, when reported, comes from the signup rows
    aggs.append(F.sum(F.when(F.col("event_type") == "signup", F.col("n"))).alias("total_votes"))
    g = v.groupBy("user_id", "day").agg(*aggs)
    return tallies.with_totals(g)


@register("json_fields", "SC-15 UD-7", oracle="""
select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k from events
""")
def json_fields_q(spark, d):
    e = read_table(spark, d, "events", "event_id", "props")
    return e.select("event_id", json_fields.json_long("props", "$.k").alias("k"))


@register("validation_split", "FLT-10 FLT-11 SC-17", oracle="""
select d.doc_id,
  case when l.doc_id is null then 'unlabeled'
       when coalesce(l.toxic in (0, 1), false) = false or coalesce(l.quality in (0, 1), false) = false then 'bad_label'
       when l.toxic = 1 then 'toxic'
       when l.quality = 0 then 'low_quality'
       when coalesce(len(regexp_extract_all(d.text, '\\S+')) >= 50, false) = false then 'too_short'
  end as reject_reason
from documents d left join labels l on l.doc_id = d.doc_id
""")
def validation_split(spark, d):
    docs = read_table(spark, d, "documents", "doc_id", "text")
    lab = read_table(spark, d, "labels", "doc_id", "quality", "toxic").withColumn("_labelled", F.lit(True))
    j = docs.join(lab, "doc_id", "left")
    rules = [
        ("unlabeled", F.col("_labelled").isNotNull()),
        ("bad_label", quality.one_of("toxic", (0, 1)) & quality.one_of("quality", (0, 1))),
        ("toxic", F.col("toxic") != 1),
        ("low_quality", F.col("quality") != 0),
        ("too_short", text.has_min_words("text", 50)),
    ]
    return quality.validate(j, rules).select("doc_id", "reject_reason")


@register("job_result_payloads", "AG-4 SNK-11 SC-15", oracle="""
select o_custkey, cast(year(o_orderdate) as integer) as filing_year,
       cast(to_json(list({'o_orderkey': o_orderkey, 'o_orderstatus': o_orderstatus} order by o_orderkey)) as varchar)
         as result
from orders group by 1, 2
""")
def job_result_payloads(spark, d):
    from filingflow.operators import concat
    o = read_table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    # one job = one company-year; its result rows become one JSON array
    jobs = o.withColumn("filing_year", F.year("o_orderdate"))
    rows = concat.collect_rows(jobs, ["o_custkey", "filing_year"], ["o_orderkey"], ["o_orderkey", "o_orderstatus"])
    return rows.select("o_custkey", "filing_year", F.to_json("rows").alias("result"))


@register("bucketed_replace", "SNK-2 SNK-6 SNK-10 JN-2", oracle="""
with b as (select *, case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end as batch_id from orders),
l as (select o_custkey, max(batch_id) as batch_id from b group by 1)
select b.o_custkey, b.o_orderkey, b.o_orderstatus from b join l using (o_custkey, batch_id) where b.o_custkey % 11 <> 0
""")
def bucketed_replace(spark, d):
    """The orders of each status as a batch that replaces its companies' rows; then some companies' rows go."""
    from filingflow.operators.bucketed import BucketedTable
    from filingflow.session import scratch_path

    o = read_table(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderstatus")
    table = BucketedTable(spark, scratch_path(spark, "bucketed"), ["o_custkey"], o.schema, buckets=16)
    for batch_id, status in enumerate(("F", "O", "P")):
        table.replace(o.where(F.col("o_orderstatus") == status), batch_id)
    table.replace(o.where("o_orderstatus = 'P'"), 2)  # the last batch once more, as after a lost driver
    table.delete(o.where("o_custkey % 11 = 0").select("o_custkey"), "deleted")
    return table.read()
