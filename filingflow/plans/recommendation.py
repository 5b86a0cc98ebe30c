"""E4: pending ballot questions -> per-question retrieval -> recommendation.

One question = one query vector scored against its own filing's chunks (an
equi-join on ``filing_id``), top-k, context, policy rules, model, validation,
then two merges from the same cached batch: results upsert and status log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filingflow.functions import keys
from filingflow.operators import concat, merge, model, quality, retrieval, status
from filingflow.session import materialize

REC_K = retrieval.RAG_TOP_K
#: Questions of one filing that share one row of passage texts.
TEXT_BLOCK = 256
RESULT_KEY = ["filing_id", "question_id"]
RESULT_RULES = {c: merge.REPLACE for c in ("voting_recommendation", "rationale", "citation", "confidence",
                                            "key_facts", "policy_breaches", "updated_at")}

REC_PROMPT = ("Policy rules:\n%s\n\nCompany: %s, meeting %s.\nQuestion %s: %s\n\n"
              "Passages:\n%s\n\nRecommend For, Against, Abstain or Withhold as JSON.")


def pending_questions(questions: DataFrame, filings: DataFrame, status_log: DataFrame | None = None,
                      only_ids: DataFrame | None = None) -> DataFrame:
    """FLT-8 + JN-3 + SC-5 + ST-5: questions whose current status is NEW or
    ERROR, however often they failed, joined to their filing; optional
    restriction to an id list."""
    q = questions
    if status_log is not None:
        cur = status.current_status(status_log, RESULT_KEY, ["seq"], ["status"])
        q = q.drop("status").join(cur, RESULT_KEY, "left") \
            .withColumn("status", F.coalesce("status", F.lit("NEW")))
    q = q.where(F.col("status").isin(*status.QUESTION_PENDING))
    if only_ids is not None:
        q = q.join(only_ids.select(*RESULT_KEY), RESULT_KEY, "left_semi")
    extra = [c for c in ("policy_id",) if c in filings.columns]
    f = filings.select("filing_id", "company_name", *extra,
                       keys.long_date("filing_date").alias("meeting_date_text"))
    # PRJ-4: the model contract calls the question text proxy_question
    return q.join(f, "filing_id").withColumnRenamed("question_text", "proxy_question")


def pending_batch(pending: DataFrame, n: int = 100) -> DataFrame:
    """SL-3: at most ``n`` pending questions per run, in a deterministic order
    (the streaming job normally takes the whole backlog instead)."""
    return pending.orderBy("filing_id", "question_id").limit(n)


def policy_texts(rules: DataFrame, policy_col: str = "policy_id") -> DataFrame:
    """SRC-10 + AG-9: ``rules`` is the policy rule table ``(policy_id,
    rule_id, rule_text)`` (sample rules only; no policy text ships here); per
    policy, its rules in id order as one newline-separated string
    ``(policy_id, policy_rules)``.  A policy is a short, bounded rule list."""
    return concat.context_concat(rules, [policy_col], ["rule_id"], "rule_text", sep="\n",
                                 name="policy_rules").select(policy_col, "policy_rules")


def question_passages(pending: DataFrame, chunks: DataFrame, k: int = REC_K) -> DataFrame:
    """JN-5b + WN-3: ``(filing_id, question_id, query_no, passages)``, the k best
    chunk numbers of each question in its own filing, best first, with the
    question embedding as the query.  Ids only; ``add_context`` joins the text."""
    # number the questions within their filing: query_no is the join key back
    per_filing = Window.partitionBy("filing_id").orderBy("question_id")
    q = pending.where(F.col("question_embedding").isNotNull()).select(
        "filing_id", F.dense_rank().over(per_filing).alias("query_no"), "question_id",
        F.col("question_embedding").alias("qv"))
    ids = q.select("filing_id", "query_no", "question_id")
    top = retrieval.top_k(chunks, q.drop("question_id"), "filing_id", "chunk_index", k).where("chunk_index is not null")
    ranked = F.array_sort(F.collect_list(F.struct("rank", "chunk_index")))
    best = top.groupBy("filing_id", "query_no").agg(F.transform(ranked, lambda s: s["chunk_index"]).alias("passages"))
    return best.join(ids, ["filing_id", "query_no"]).select("filing_id", "question_id", "query_no", "passages")


def add_context(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """AG-2: ``rows`` (filing_id, query_no, passages, ...) with ``context``, the
    passages' texts in order with blank lines between, and ``n_parts``.

    Questions of a filing share most passages: a block of ``TEXT_BLOCK``
    questions gets each text once, and contexts are put together in the stage
    that reads them, so none is shuffled.
    """
    of = F.floor(F.col("query_no") / TEXT_BLOCK).alias("_block")
    need = rows.select("filing_id", of, F.explode("passages").alias("chunk_index")).distinct()
    # a chunk number that occurs again has several texts, in text order
    texts = chunks.groupBy("filing_id", "chunk_index").agg(F.array_sort(F.collect_list(F.struct("chunk_text"))).alias("t"))
    texts = texts.select("filing_id", "chunk_index", F.transform("t", lambda s: s["chunk_text"]).alias("t"))
    blocks = texts.join(need, ["filing_id", "chunk_index"]).groupBy("filing_id", "_block") \
        .agg(F.map_from_entries(F.collect_list(F.struct("chunk_index", "t"))).alias("_texts"))
    parts = F.flatten(F.transform("passages", lambda i: F.element_at("_texts", i)))
    return rows.withColumn("_block", of).join(blocks, ["filing_id", "_block"], "left").select(
        *rows.columns, F.array_join(parts, "\n\n").alias("context"), F.size(parts).alias("n_parts"))


def question_contexts(pending: DataFrame, chunks: DataFrame, k: int = REC_K) -> DataFrame:
    """JN-5b + WN-3 + AG-2: context per question from its own filing's chunks,
    using the question embedding as the query."""
    return add_context(question_passages(pending, chunks, k), chunks).drop("query_no", "passages")


def recommend(pending: DataFrame, contexts: DataFrame, policies: DataFrame, fn: model.ModelFn,
              custom_policy: str | None = None, max_concurrency: int | None = None,
              store_output: bool = True, chunks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """SC-19 + UD-3 + UD-7 + SC-17: ``(results, failures)``.

    ``contexts`` is ``(filing_id, question_id, context)``; with ``chunks`` it is
    ``question_passages`` and the text joins last, right before the calls.
    ``pending`` carries a ``policy_id`` (the client's voting policy) and
    ``policies`` is ``(policy_id, policy_rules)`` from ``policy_texts`` -- an
    equi-join on a table with one short row per policy, which AQE
    broadcasts.  A non-empty ``custom_policy`` replaces the stored rules
    (SC-16).  Calls in flight are bounded by the task slots; ``max_concurrency``
    lowers that to a number of partitions the caller names.  With ``store_output`` the raw model
    output is written once to the checkpoint folder, so results and failures
    come from the same calls and the model is never re-run.
    """
    text = ["context"] if chunks is None else ["query_no", "passages"]
    src = pending.join(contexts.select(*RESULT_KEY, *text), RESULT_KEY, "left") \
        .join(policies.select("policy_id", "policy_rules"), "policy_id", "left")
    if chunks is not None:
        src = add_context(src, chunks)
    src = src.withColumn("context", F.coalesce("context", F.lit(""))) \
        .withColumn("policy", F.coalesce(keys.first_truthy(F.lit(custom_policy or ""), "policy_rules"),
                                         F.lit("")))
    src = src.withColumn("prompt", F.format_string(
        REC_PROMPT, "policy", F.coalesce("company_name", F.lit("")),
        F.coalesce("meeting_date_text", F.lit("")), "question_id", "proxy_question", "context"))
    # the model sees the prompt (which carries policy and passages) and the question
    out = model.apply_model(src, fn, ["question_id", "proxy_question", "prompt"],
                            ["filing_id", "question_id"], max_concurrency=max_concurrency)
    if store_output:
        out = materialize(out, "recommendation-output")
    parsed = model.parse_output(out, model.REC_SCHEMA)
    rec = parsed.select("filing_id", "question_id", "model_error", "parsed",
                        F.col("parsed.voting_recommendation").alias("voting_recommendation"),
                        F.col("parsed.rationale").alias("rationale"),
                        F.col("parsed.citation").alias("citation"),
                        F.col("parsed.confidence").try_cast("double").alias("confidence"),
                        F.col("parsed.key_facts").alias("key_facts"),
                        F.col("parsed.policy_breaches").alias("policy_breaches"))
    tagged = quality.validate(rec, [
        ("model error", F.col("model_error").isNull()),
        ("malformed model output", F.col("parsed").isNotNull() & F.col("parsed._corrupt_record").isNull()),
        ("bad recommendation", quality.one_of("voting_recommendation", model.RECOMMENDATIONS)),
        ("confidence out of range", quality.within("confidence", 0.0, 1.0)),
    ])
    good, bad = quality.split(tagged)
    results = good.drop("model_error", "parsed").withColumn("updated_at", F.current_timestamp())
    reason = F.when(F.col("model_error").isNotNull(), F.concat(F.lit("model error: "), F.col("model_error"))) \
        .otherwise(F.col("reject_reason"))
    return results, bad.select("filing_id", "question_id", reason.alias("reject_reason"))


def store_results(target: DataFrame, results: DataFrame) -> DataFrame:
    """SNK-8 (first merge): upsert recommendations by (filing_id, question_id)."""
    return merge.upsert(target, results, RESULT_KEY, RESULT_RULES)


def status_entries(results: DataFrame, failures: DataFrame, seq: int) -> DataFrame:
    """SNK-8 (second merge) / SNK-9: DONE for stored results, ERROR with the
    reason for failures, as status-log rows at sequence ``seq``."""
    ok = results.select(*RESULT_KEY, F.lit("DONE").alias("status"), F.lit(None).cast("string").alias("error_msg"))
    err = failures.select(*RESULT_KEY, F.lit("ERROR").alias("status"), F.col("reject_reason").alias("error_msg"))
    return ok.unionByName(err).withColumn("seq", F.lit(seq).cast("bigint")) \
        .withColumn("last_attempt", F.current_timestamp())
