"""Registered retrieval and context-assembly queries.

Embeddings stand in for chunk vectors: ``label`` is the filing, ``vec_id`` the
chunk position.  The query vectors are per-filing passages (the filing's first
chunk, or first five chunks), so the work is one equi-join on the filing and a
bounded number of scores per chunk.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from filingflow.functions import keys
from filingflow.operators import concat, ranking, retrieval
from filingflow.plans.catalog import register
from filingflow.sources.tables import read_table

_SQL_QUERIES = """
q as (select label, embedding as qv, row_number() over (partition by label order by vec_id) - 1 as query_no
      from embeddings qualify query_no < {n}),
s as (select e.label, e.vec_id, q.query_no,
             list_inner_product(cast(e.embedding as double[]), cast(q.qv as double[])) as sc
      from embeddings e join q on q.label = e.label)"""


def _emb(spark, d):
    return read_table(spark, d, "embeddings", "vec_id", "embedding", "label")


@register("vector_topk", "JN-5 WN-3 SC-14", oracle="with " + _SQL_QUERIES.format(n=1) + """
select label, vec_id, rank, round(sc, 6) as score from (
  select label, vec_id, sc, row_number() over (partition by label order by sc desc, vec_id) as rank from s)
where rank <= 20
""")
def vector_topk(spark, d):
    e = _emb(spark, d)
    q = retrieval.first_rows_as_queries(e, "label", "vec_id", n=1)
    top = retrieval.top_k(e, q, "label", "vec_id", 20)
    return top.select("label", "vec_id", F.col("rank").cast("bigint").alias("rank"),
                      F.round("score", 6).alias("score"))


@register("multi_query_first_seen", "WN-4 AG-8 WN-3 JN-5", oracle="with " + _SQL_QUERIES.format(n=5) + """,
t as (select *, row_number() over (partition by label, query_no order by sc desc, vec_id) as rk
      from s qualify rk <= 20),
f as (select label, vec_id, min(query_no * 1000000 + rk) as first from t group by label, vec_id)
select label, vec_id, merged_rank from (
  select label, vec_id, row_number() over (partition by label order by first) as merged_rank from f)
where merged_rank <= 20
""")
def multi_query_first_seen(spark, d):
    e = _emb(spark, d)
    q = retrieval.first_rows_as_queries(e, "label", "vec_id", n=5)
    out = retrieval.retrieve(e, q, "label", "vec_id", k=20, merge="first_seen")
    return out.select("label", "vec_id", F.col("merged_rank").cast("bigint").alias("merged_rank"))


@register("multi_query_best_score", "WN-4 WN-3 JN-5 SC-14", oracle="with " + _SQL_QUERIES.format(n=5) + """,
b as (select label, vec_id, max(sc) as best from s group by label, vec_id)
select label, vec_id, merged_rank, round(best, 6) as best_score from (
  select label, vec_id, best, row_number() over (partition by label order by best desc, vec_id) as merged_rank from b)
where merged_rank <= 20
""")
def multi_query_best_score(spark, d):
    e = _emb(spark, d)
    q = retrieval.first_rows_as_queries(e, "label", "vec_id", n=5)
    out = retrieval.retrieve(e, q, "label", "vec_id", k=20, merge="best_score")
    return out.select("label", "vec_id", F.col("merged_rank").cast("bigint").alias("merged_rank"),
                      F.round("best_score", 6).alias("best_score"))


@register("context_concat", "AG-2 WN-3", oracle="""
select source, string_agg(text, '

' order by rk) as context, count(*) as n_parts
from (select source, text, row_number() over (partition by source order by n_chars desc, doc_id) as rk
      from documents qualify rk <= 20)
group by source
""")
def context_concat(spark, d):
    docs = read_table(spark, d, "documents", "doc_id", "text", "source", "n_chars")
    top = ranking.top_n_per_group(docs, ["source"], [F.desc("n_chars"), F.asc("doc_id")], 20, "rk")
    out = concat.context_concat(top, ["source"], ["rk"], "text")
    return out.select("source", "context", F.col("n_parts").cast("bigint").alias("n_parts"))


@register("page_concat", "AG-3 FLT-12 UD-6", oracle="""
select conv_id,
       coalesce(string_agg(text || '
', '' order by turn) filter (where text is not null and length(text) > 0), '') as text
from conversations group by conv_id
""")
def page_concat(spark, d):
    c = read_table(spark, d, "conversations", "conv_id", "turn", "text")
    return concat.page_concat(c, ["conv_id"], "turn", "text")


@register("rules_joined", "AG-9 SC-16 SRC-10", oracle="""
select cast(item_id // 20 as bigint) as policy_page, count(*) as n_rules,
       coalesce(nullif(string_agg(text, '
' order by item_id), ''), 'no policy rules') as policy_text
from benchmark group by 1
""")
def rules_joined(spark, d):
    b = read_table(spark, d, "benchmark", "item_id", "text")
    # rule pages of at most 20 rules (bounded groups)
    pages = b.withColumn("policy_page", F.floor(F.col("item_id") / 20).cast("bigint"))
    out = concat.context_concat(pages, ["policy_page"], ["item_id"], "text", sep="\n", name="policy_text")
    return out.select("policy_page", F.col("n_parts").cast("bigint").alias("n_rules"),
                      keys.first_truthy("policy_text", F.lit("no policy rules")).alias("policy_text"))


def _phrase_vectors() -> list[list[float]]:
    from filingflow.plans import proxy_ingest
    return proxy_ingest.query_vectors()


def _phrase_sql() -> str:
    vals = ", ".join(f"({i}, [{', '.join(repr(float(x)) for x in v)}]::DOUBLE[])"
                     for i, v in enumerate(_phrase_vectors()))
    return f"q(query_no, qv) as (values {vals})"


@register("phrase_query_retrieval", "JN-5 WN-3 WN-4 AG-8 SRC-11 UD-4 SC-14", oracle=f"""
with {_phrase_sql()},
s as (select e.label, e.vec_id, q.query_no,
             list_inner_product(cast(e.embedding as double[]), q.qv) as sc
      from embeddings e, q),
t as (select *, row_number() over (partition by label, query_no order by sc desc, vec_id) as rk
      from s qualify rk <= 20),
f as (select label, vec_id, min(query_no * 1000000 + rk) as first from t group by label, vec_id)
select label, vec_id, merged_rank from (
  select label, vec_id, row_number() over (partition by label order by first) as merged_rank from f)
where merged_rank <= 20
""")
def phrase_query_retrieval(spark, d):
    # the five fixed query phrases, embedded once, against every chunk of every filing
    e = _emb(spark, d)
    out = retrieval.retrieve(e, _phrase_vectors(), "label", "vec_id", k=20, merge="first_seen")
    return out.select("label", "vec_id", F.col("merged_rank").cast("bigint").alias("merged_rank"))
