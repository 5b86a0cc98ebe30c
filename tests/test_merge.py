"""Merges, tallies, questions (FIXTURES C7, C8) and merge properties."""

import json

from pyspark.sql import functions as F

from filingflow.operators import merge, model, tallies
from filingflow.plans import proxy_ingest, vote_extraction

TALLY = "for_votes long, against_votes long, abstentions long, broker_non_votes long, total_votes long"


def test_totals(spark):
    df = spark.createDataFrame([(10, 2, 1, 0, None), (10, 2, 1, None, None), (10, 2, 1, 0, 20)], TALLY)
    got = [(r["total_votes"], r["computed_total"], r["total_mismatch"]) for r in tallies.with_totals(df).collect()]
    assert got == [(13, 13, False), (None, None, False), (20, 13, True)]


def _parsed(spark, docs):
    rows = [("j", "1", json.dumps(d) if not isinstance(d, str) else d, None) for d in docs]
    df = spark.createDataFrame(rows, "job_id string, cik string, model_output string, model_error string")
    return model.parse_output(df, model.TALLY_SCHEMA)


def vr(q, f=10, a=2, ab=1, b=0, t=None):
    return {"questionId": q, "resolution": "r", "total_votes": t, "for": f, "against": a,
            "abstentions": ab, "broker_non_votes": b}


def test_tally_validation(spark):
    docs = [
        {"ticker": "T", "meeting_date": "2022-05-06", "voting_results": [vr("1"), vr("2", b=None), vr("3", t=20),
                                                                          vr("4", f="x"), vr("5", f=None)]},
        {"ticker": "", "meeting_date": "2022-05-06", "voting_results": [vr("1")]},
        "{not json",
    ]
    good, bad = vote_extraction.tally_rows(_parsed(spark, docs))
    g = {r["question_id"]: (r["total_votes"], r["total_mismatch"]) for r in good.collect()}
    assert g == {"1": (13, False), "2": (None, False), "3": (20, True), "5": (None, False)}
    reasons = sorted(r["reject_reason"] for r in bad.collect())
    assert reasons == ["bad for", "malformed model output", "ticker missing"]


def test_insert_ignore_votes(spark):
    cols = ", ".join(f"{c} string" for c in vote_extraction.VOTE_COLUMNS)
    target = spark.createDataFrame([("c", "T", "2022-05-06", "1", "old") + (None,) * 6], cols)
    batch = spark.createDataFrame(
        [("c", "T", "2022-05-06", "1", "new") + (None,) * 6 + (0,),
         ("c", "T", "2022-05-06", "2", "first") + (None,) * 6 + (0,),
         ("c", "T", "2022-05-06", "2", "second") + (None,) * 6 + (1,),
         ("c", "T", None, "3", "nullkey") + (None,) * 6 + (2,),
         ("c", "T", None, "3", "nullkey2") + (None,) * 6 + (3,)], cols + ", position int")
    merged, inserted = vote_extraction.store_votes(target, batch)
    got = sorted((r["question_id"], r["resolution"]) for r in merged.collect())
    assert got == [("1", "old"), ("2", "first"), ("3", "nullkey"), ("3", "nullkey2")]
    assert inserted.count() == 3


QCOLS = ("filing_id long, question_id string, question_text string, board_vote_recommend string, "
         "question_type string, is_shareholder boolean, question_embedding array<float>, status string")


def test_questions_upsert_keep_embedding(spark):
    target = spark.createDataFrame([
        (1, "1a", "old", "For", "other", False, [1.0], "NEW"),
        (2, "1a", "other filing", "For", "other", False, [2.0], "NEW")], QCOLS)
    batch = spark.createDataFrame([
        (1, "1a", "mid", "For", "other", False, [9.0], "NEW", 0),
        (1, "1a", "new", "Against", "other", True, None, "NEW", 1),
        (1, "1b", "added", "For", "other", False, None, "NEW", 0)], QCOLS + ", pos int")
    out = {(r["filing_id"], r["question_id"]): r for r in
           proxy_ingest.store_questions(target, batch, order_col="pos").collect()}
    assert out[(1, "1a")]["question_text"] == "new" and out[(1, "1a")]["question_embedding"] == [9.0]
    assert out[(2, "1a")]["question_text"] == "other filing"
    assert out[(1, "1b")]["question_embedding"] is None


def test_question_validation(spark):
    docs = [json.dumps({"proxy_questions": [
        {"question_id": "1", "question_text": "q", "board_vote_recommendation": "Maybe",
         "question_type": "other", "is_shareholder_proposal": "false"},
        {"question_id": "2", "question_text": "q", "board_vote_recommendation": "For",
         "question_type": "compensation", "is_shareholder_proposal": "true"}]})]
    ctx = spark.createDataFrame([(7, "ctx")], "filing_id long, context string")
    good, bad = proxy_ingest.extract_questions(ctx, lambda pdf: docs * len(pdf))
    assert [r["question_id"] for r in good.collect()] == ["2"]
    assert [r["reject_reason"] for r in bad.collect()] == ["bad board vote"]


def test_model_errors_are_isolated(spark):
    df = spark.createDataFrame([(1, "ok"), (2, "boom"), (3, "ok")], "id int, t string")

    def fn(pdf):
        if (pdf["t"] == "boom").any():
            raise ValueError("bad row")
        return ["{}"] * len(pdf)
    got = {r["id"]: r["model_error"] for r in model.apply_model(df, fn, ["t"], ["id"]).collect()}
    assert got[1] is None and got[3] is None and "bad row" in got[2]


def test_upsert_idempotent_and_equals_anti_union(spark):
    t = spark.range(0, 50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    b = spark.range(40, 60).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v"))
    rules = {"v": merge.REPLACE}
    once = merge.upsert(t, b, ["k"], rules)
    twice = merge.upsert(once, b, ["k"], rules)
    assert sorted(once.collect()) == sorted(twice.collect())
    alt = t.join(b.select("k"), "k", "left_anti").unionByName(b)
    assert sorted(once.collect()) == sorted(alt.collect())


def test_replace_by_key_and_skip_done(spark):
    t = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "f int, c int")
    b = spark.createDataFrame([(1, 5)], "f int, c int")
    assert sorted(tuple(r) for r in merge.replace_by_key(t, b, ["f"]).collect()) == [(1, 5), (2, 0)]
    cand = spark.createDataFrame([(1,), (2,), (3,)], "f int")
    done = spark.createDataFrame([(1,), (2,)], "f int")
    redo = spark.createDataFrame([(2,)], "f int")
    assert sorted(r["f"] for r in merge.skip_done(cand, done, ["f"], redo).collect()) == [2, 3]


def test_counts(spark):
    from filingflow.operators import chunking
    df = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "f int, c int")
    counts = {r["f"]: r["n"] for r in chunking.count_per_key(df, ["f"]).collect()}
    assert counts == {1: 2, 2: 1}


def test_null_keys_survive_an_ordered_upsert(spark):
    schema = "filing_id long, question_id string, v string, e string, seq int"
    batch = spark.createDataFrame([(1, "a", "old", "x", 1), (1, "a", "new", None, 2), (None, "b", "n", "y", 1), (1, None, "m", None, 1)], schema)
    target = spark.createDataFrame([(1, "a", "stored", "z")], "filing_id long, question_id string, v string, e string")
    rules = {"v": merge.REPLACE, "e": merge.KEEP_IF_NULL}
    got = merge.upsert(target, batch, ["filing_id", "question_id"], rules, "seq").collect()
    assert sorted(tuple(map(str, r)) for r in got) == [("1", "None", "m", "None"), ("1", "a", "new", "x"), ("None", "b", "n", "y")]


def test_null_texts_are_embedded_once(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "a b"), (4, None)], "id int, t string")
    plain = {r["id"]: r["e"] for r in df.withColumn("e", model.embed_column("t")).collect()}
    once = {r["id"]: r["embedding"] for r in model.embed_texts_once(df, "t").collect()}
    assert once == plain


def test_recommendation_contract_strings(spark):
    out = spark.createDataFrame([(json.dumps({"voting_recommendation": "For", "confidence": 0.5, "key_facts": "two facts", "policy_breaches": "none"}),)], "model_output string")
    parsed = model.parse_output(out, model.REC_SCHEMA).first()["parsed"]
    assert parsed["_corrupt_record"] is None and parsed["key_facts"] == "two facts"


def test_error_texts_are_whole(spark):
    def fails(pdf):
        raise RuntimeError("x" * 5000)
    df = spark.createDataFrame([(1, "a")], "id int, t string")
    assert len(model.apply_model(df, fails, ["t"], ["id"]).first()["model_error"]) > 5000


def test_model_and_embedder_factories_run_once_per_task(spark):
    df = spark.range(0, 50, numPartitions=2).select(F.col("id"), F.col("id").cast("string").alias("t"))

    def make_model():
        import os
        pid = os.getpid()
        return lambda pdf: [json.dumps({"pid": pid})] * len(pdf)
    out = model.apply_model(df, None, ["t"], ["id"], factory=make_model).collect()
    assert len(out) == 50 and all(r["model_error"] is None for r in out)

    def make_embedder():
        base = model.hashing_embedder(8)
        return base
    emb = df.select(model.embed_column("t", factory=make_embedder).alias("e")).collect()
    assert all(len(r["e"]) == 8 for r in emb)


def test_recommendation_validation(spark):
    from filingflow.plans import recommendation
    pending = spark.createDataFrame([(1, "1a", "q", "Co", "June 05 2025", 0), (1, "1b", "q", "Co", None, 0),
                                     (1, "1c", "q", "Co", None, 0)],
                                    "filing_id long, question_id string, proxy_question string, "
                                    "company_name string, meeting_date_text string, policy_id int")
    contexts = spark.createDataFrame([(1, "1a", "ctx")], "filing_id long, question_id string, context string")
    policies = spark.createDataFrame([(0, "Rule.")], "policy_id int, policy_rules string")
    answers = {"1a": {"voting_recommendation": "For", "confidence": 0.7},
               "1b": {"voting_recommendation": "Maybe", "confidence": 0.5},
               "1c": {"voting_recommendation": "Against", "confidence": 1.2}}

    def fn(pdf):
        return [json.dumps({"question_id": q, **answers[q]}) for q in pdf["question_id"]]
    res, bad = recommendation.recommend(pending, contexts, policies, fn, max_concurrency=None)
    assert [(r["question_id"], r["confidence"]) for r in res.collect()] == [("1a", 0.7)]
    assert {r["question_id"]: r["reject_reason"] for r in bad.collect()} == {
        "1b": "bad recommendation", "1c": "confidence out of range"}


def test_model_row_retries(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    marker = str(tmp_path / "calls")

    def flaky(pdf):
        # row "b" fails on its first two single-row calls, then succeeds
        import os
        if len(pdf) > 1:
            raise RuntimeError("batch failed")
        if pdf["t"].iloc[0] == "b":
            n = len(os.listdir(marker)) if os.path.isdir(marker) else 0
            os.makedirs(marker, exist_ok=True)
            open(os.path.join(marker, str(n)), "w").close()
            if n < 2:
                raise RuntimeError("transient")
        return ["{}"]
    ok = {r["id"]: r["model_error"] for r in model.apply_model(df.coalesce(1), flaky, ["t"], ["id"], retries=3).collect()}
    assert ok == {1: None, 2: None}


def test_model_called_in_bounded_slices(spark):
    df = spark.range(0, 600, numPartitions=1).select(F.col("id"), F.col("id").cast("string").alias("t"))

    def sized(pdf):
        if len(pdf) > 100:
            raise ValueError("request too large")
        return [json.dumps({"n": len(pdf)})] * len(pdf)
    out = model.apply_model(df, sized, ["t"], ["id"], call_rows=100).collect()
    assert all(r["model_error"] is None and json.loads(r["model_output"])["n"] <= 100 for r in out)


def test_embedder_holds_the_words_of_a_slice_only():
    import tracemalloc

    import numpy as np
    import pandas as pd

    texts = pd.Series([" ".join(f"w{i % 7}x{j}" for j in range(800)) for i in range(1500)] + [None, "", "x"])
    embed = model.hashing_embedder()
    tracemalloc.start()
    got = embed(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20, peak
    alone = [embed(texts.iloc[i:i + 1]).iloc[0] for i in (0, 8, 1499, 1500, 1501, 1502)]
    assert len(got) == len(texts) and all(np.array_equal(a, got.iloc[i]) for a, i in zip(alone, (0, 8, 1499, 1500, 1501, 1502)))
    assert len(embed(pd.Series([], dtype=object))) == 0
