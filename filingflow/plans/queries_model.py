"""Registered model-stage queries.

Model output has no SQL oracle (rows-only checks), its parsing has.  They run the real plans over whole tables with the deterministic stub models
standing in for hosted services.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from filingflow.functions import text
from filingflow.operators import model, quality, tallies
from filingflow.operators.parallel import by_setting
from filingflow.plans import proxy_ingest
from filingflow.plans.catalog import register
from filingflow.session import materialize
from filingflow.sources.tables import read_table


# Model output of five kinds, by event type: as it should be, cut off, with a field of another type, with
# fields that nobody asked for, and none at all.
@register("parsed_model_output", "UD-7", oracle="""
with o as (select event_id, case event_type when 'view' then props when 'click' then substr(props, 1, 5)
                  when 'error' then '{"k": "' || event_id || '?"}' when 'purchase' then replace(props, '}', ', "more": [{"k": 1}]}') end as out
           from events)
select event_id, case when ok then cast(json_extract(out, '$.k') as bigint) end as k,
       case when out is null then 'no output' when not ok then 'malformed model output' end as reject_reason
from (select event_id, out, coalesce(case when json_valid(out) then json_type(out, '$.k') = 'UBIGINT' else false end, false) as ok
      from o)
""")
def parsed_model_output(spark, d):
    e = read_table(spark, d, "events", "event_id", "event_type", "props")
    kind = F.col("event_type")
    out = F.when(kind == "view", F.col("props")).when(kind == "click", F.substring("props", 1, 5)) \
        .when(kind == "error", F.concat(F.lit('{"k": "'), "event_id", F.lit('?"}'))) \
        .when(kind == "purchase", F.replace("props", F.lit("}"), F.lit(', "more": [{"k": 1}]}')))
    src = e.select("event_id", out.alias("model_output"), F.lit(None).cast("string").alias("model_error"))
    parsed = model.parse_output(src, StructType([StructField("k", LongType())]))
    tagged = quality.validate(parsed, [("no output", F.col("model_output").isNotNull()),
                                       ("malformed model output", model.parse_ok())])
    good = F.col("reject_reason").isNull()
    return tagged.select("event_id", F.when(good, F.col("parsed.k")).alias("k"), "reject_reason")


@register("proxy_questions", "UD-2 UD-4 UD-7 SC-17 SC-19 SRC-11 JN-5 WN-4 AG-2 WN-5")
def proxy_questions(spark, d):
    docs = by_setting(read_table(spark, d, "documents", "doc_id", "text"), ["doc_id"]) \
        .withColumnRenamed("doc_id", "filing_id")
    good, _rejects = proxy_ingest.questions_from_documents(docs)
    return good.select("filing_id", "question_id", "question_text", "board_vote_recommend",
                       "question_type", "is_shareholder", "status")


@register("tally_extraction", "UD-1 UD-7 AG-6 SC-6")
def tally_extraction(spark, d):
    pages = by_setting(read_table(spark, d, "pages", "page_id", "url", "html"), ["page_id"])
    src = text.add_clean_text(pages, "html").select(
        "page_id", "text", F.regexp_extract("url", r"//([^./]+)", 1).alias("ticker"),
        F.lit("2024-01-01").alias("meeting_date"))
    out = model.apply_model(src, model.stub_tally_model(), ["text", "ticker", "meeting_date"], ["page_id"])
    parsed = model.parse_output(out, model.TALLY_SCHEMA).where(model.parse_ok())
    rows = parsed.select("page_id", "parsed.ticker", "parsed.meeting_date", F.inline("parsed.voting_results"))
    typed = rows.select(
        "page_id", "ticker", "meeting_date", F.col("questionId").alias("question_id"), "resolution",
        F.col("total_votes").try_cast("bigint").alias("total_votes"),
        F.col("for").try_cast("bigint").alias("for_votes"),
        F.col("against").try_cast("bigint").alias("against_votes"),
        F.col("abstentions").try_cast("bigint").alias("abstentions"),
        F.col("broker_non_votes").try_cast("bigint").alias("broker_non_votes"))
    return tallies.with_totals(typed)


@register("question_recommendations", "UD-3 UD-4 JN-3 JN-5 WN-3 AG-2 AG-9 SC-5 SC-16 SC-17 SNK-8 SNK-9 FLT-8 ST-3")
def question_recommendations(spark, d):
    from filingflow.plans import recommendation
    docs = by_setting(read_table(spark, d, "documents", "doc_id", "text", "source"), ["doc_id"])
    filings = docs.select(F.col("doc_id").alias("filing_id"), "text",
                          F.col("source").alias("company_name"))
    kept = filings.where(text.has_min_words("text", proxy_ingest.MIN_FILING_WORDS))
    # embedded chunks feed two retrievals: store them once
    chunks = materialize(proxy_ingest.embed_chunks(proxy_ingest.filing_chunks(kept)), "embedded-chunks")
    ctx = proxy_ingest.retrieval_context(chunks, proxy_ingest.query_vectors())
    questions, _ = proxy_ingest.extract_questions(ctx, model.stub_question_model())
    # Q17: question embeddings come from the same embedder
    questions = materialize(questions.withColumn("question_embedding", model.embed_column("question_text")),
                            "questions")
    # each company follows one voting policy: pages of at most 20 rules
    rules = read_table(spark, d, "benchmark", "item_id", "text").select(
        F.floor(F.col("item_id") / 20).cast("bigint").alias("policy_id"),
        F.col("item_id").alias("rule_id"), F.col("text").alias("rule_text"))
    policies = recommendation.policy_texts(rules)
    n_policies = policies.count()
    fil = kept.select("filing_id", "company_name", F.lit(None).cast("date").alias("filing_date"),
                      F.pmod(F.xxhash64("company_name"), F.lit(max(n_policies, 1))).alias("policy_id"))
    pending = recommendation.pending_questions(questions, fil)
    passages = recommendation.question_passages(pending, chunks)
    results, failures = recommendation.recommend(pending, passages, policies, model.stub_recommendation_model(),
                                                 max_concurrency=None, chunks=chunks)
    status_log = recommendation.status_entries(results, failures, 1)
    return status_log.join(results.select("filing_id", "question_id", "voting_recommendation", "confidence"),
                           ["filing_id", "question_id"], "left") \
        .select("filing_id", "question_id", "status", "error_msg", "voting_recommendation", "confidence")
