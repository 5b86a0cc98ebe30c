"""End-to-end plans on hand-built inputs: E1 ingest, E2 votes, E4 recommendations."""

import json

from pyspark.sql import functions as F

from filingflow.operators import model
from filingflow.plans import proxy_ingest, recommendation, vote_extraction
from filingflow.sources import filing_index

WORDS = " ".join(f"word{i}." if i % 9 == 8 else f"word{i}" for i in range(1200))


def index_rows(spark):
    rows = [("1", "0000000001-22-000001", "2022-05-10", "8-K", "5.07", "a.htm", "2022-05-06"),
            ("1", "0000000001-22-000002", "2022-05-12", "8-K/A", "5.07,9.01", None, "2022-05-06"),
            ("1", "0000000001-22-000004", "2022-04-01", "DEF 14A", None, "d.htm", None),
            ("1", "0000000001-22-000006", "2022-04-20", "defr14a", None, "g.htm", None),
            ("2", "0000000002-22-000001", "2022-03-01", "DEF 14A", None, "x.htm", None)]
    df = spark.createDataFrame(rows, "cik string, accessionNumber string, filingDate string, form string, "
                                     "items string, primaryDocument string, meetingDate string")
    return filing_index.normalise(df)


def test_e2_votes(spark):
    idx = index_rows(spark)
    jobs = spark.createDataFrame([("j1", "1", 2022), ("j2", "7", 2022)], "job_id string, cik string, year int")
    cands = vote_extraction.candidate_filings(jobs, idx)
    assert [(r["job_id"], r["accessionNumber"][-2:], r["primaryDocument"]) for r in cands.collect()] == [
        ("j1", "02", "primary_doc.htm")]
    url = "https://www.sec.gov/Archives/edgar/data/1/000000000122000002/primary_doc.htm"
    docs = spark.createDataFrame([(url, '<p style="x">Item&nbsp;5.07 Submission. Votes were cast.</p>')],
                                 "url string, html string")
    good, bad = vote_extraction.filing_documents(cands, docs)
    assert bad.count() == 0 and "style" not in good.first()["clean_html"]
    tallies, rejects = vote_extraction.extract_tallies(
        good.withColumn("ticker", F.lit("T")), model.stub_tally_model("prompt", "ticker", "meeting_date"))
    assert tallies.count() >= 1 and rejects.count() == 0
    target = spark.createDataFrame([], ", ".join(f"{c} string" for c in vote_extraction.VOTE_COLUMNS))
    merged, inserted = vote_extraction.store_votes(target, tallies)
    assert merged.count() == inserted.count() == tallies.count()
    payload = json.loads(vote_extraction.job_payloads(tallies).first()["result"])
    assert payload[0]["question_id"] == "1"


def test_e1_ingest_and_e4_recommend(spark):
    idx = index_rows(spark)
    sel = proxy_ingest.select_proxy_filings(idx, 2022)
    stored = spark.createDataFrame([("0000000002_0000000002-22-000001",)], "proxy_id string")
    new = proxy_ingest.new_filings(sel, stored)
    assert sorted(r["accession_number"][-2:] for r in new.collect()) == ["04", "06"]
    docs = spark.createDataFrame(
        [(r["url"], f"<html><p>{WORDS}</p></html>" if r["accession_number"].endswith("04") else "<p>short</p>")
         for r in new.collect()], "url string, html string")
    texts, rejects = proxy_ingest.filing_texts(new, docs)
    assert [r["reject_reason"] for r in rejects.collect()] == ["too short"]
    companies = spark.createDataFrame([("0000000001", "A Two", "ATWO", "Y")],
                                      "cik string, name string, ticker string, exchange string")
    filings = proxy_ingest.filing_records(texts, companies)
    assert filings.first()["name"] == "A Two"
    chunks = proxy_ingest.filing_chunks(filings)
    assert chunks.count() == 2
    emb = proxy_ingest.embed_chunks(chunks)
    ctx = proxy_ingest.retrieval_context(emb, proxy_ingest.query_vectors())
    assert ctx.first()["n_parts"] == 2
    qs, bad = proxy_ingest.extract_questions(ctx, model.stub_question_model(min_words=9))
    n = qs.count()
    assert n > 100 and bad.count() == 0  # all whole sentences of both chunks
    # E4: embed question texts (Q17), retrieve per question, recommend
    qs_e = qs.withColumn("question_embedding", model.embed_column("question_text"))
    fil = filings.select("filing_id", F.col("name").alias("company_name"), "filing_date",
                         F.lit(7).alias("policy_id"))
    pending = recommendation.pending_questions(qs_e, fil)
    contexts = recommendation.question_contexts(pending, emb, k=1)
    assert contexts.count() == n
    rules = spark.createDataFrame([(7, 1, "Rule one."), (7, 2, "Rule two.")],
                                  "policy_id int, rule_id int, rule_text string")
    policies = recommendation.policy_texts(rules)
    assert policies.first()["policy_rules"] == "Rule one.\nRule two."
    res, fails = recommendation.recommend(pending, contexts, policies, model.stub_recommendation_model())
    assert res.count() + fails.count() == n
    log = recommendation.status_entries(res, fails, 1)
    assert set(r["status"] for r in log.collect()) <= {"DONE", "ERROR"}
    again = recommendation.pending_questions(qs_e, fil, log.select("filing_id", "question_id", "status", "seq"))
    assert again.count() == fails.count()


def test_tasks_facade_ingest(spark, tmp_path):
    from filingflow import tasks
    (tmp_path / "idx").mkdir()
    (tmp_path / "idx" / "c1.json").write_text(json.dumps({"cik": "1", "filings": {"recent": {
        "accessionNumber": ["0000000001-22-000004", "0000000001-22-000005"], "filingDate": ["2022-04-01", "2022-04-15"],
        "form": ["DEF 14A", "DEFA14A"], "primaryDocument": ["d.htm", "f.htm"]}}}))
    (tmp_path / "companies.json").write_text(json.dumps({"fields": ["cik", "name", "ticker", "exchange"],
                                                         "data": [[1, "A One", "AONE", "X"]]}))
    docs = spark.createDataFrame([("https://www.sec.gov/Archives/edgar/data/1/000000000122000004/d.htm",
                                   f"<p>{WORDS}</p>")], "url string, html string")
    stored = spark.createDataFrame([], "proxy_id string")
    filings, chunks, rejects = tasks.ingest_proxy_statements(
        spark, str(tmp_path / "idx"), docs, stored, 2022, str(tmp_path / "companies.json"))
    f = filings.collect()
    assert len(f) == 1 and f[0]["name"] == "A One" and f[0]["proxy_id"].endswith("22-000004")
    assert chunks.count() == 2 and rejects.count() == 0
    qs, bad = tasks.extract_ballot_questions(chunks, model.stub_question_model(min_words=9))
    assert qs.count() > 100


def test_contexts_are_put_together_behind_the_last_shuffle(spark):
    """A context repeats most of its filing's text, so no exchange may carry one."""
    chunks = spark.createDataFrame([(1, i, f"t{i}", [1.0, float(i)]) for i in range(5)] + [(1, 3, "again", [1.0, 3.0])],
                                   "filing_id long, chunk_index int, chunk_text string, embedding array<float>")
    asked = [(1, f"q{i:03d}", f"Q{i}", [0.0, 1.0 if i % 2 else -1.0]) for i in range(300)] + [(1, "none", "N", None), (2, "far", "F", [0.0, 1.0])]
    pending = spark.createDataFrame(asked, "filing_id long, question_id string, proxy_question string, question_embedding array<float>") \
        .withColumns({"company_name": F.lit("C"), "meeting_date_text": F.lit(None).cast("string"), "policy_id": F.lit(7)})
    policies = spark.createDataFrame([(7, "R")], "policy_id int, policy_rules string")
    passages = recommendation.question_passages(pending, chunks, k=3)
    want = {f"q{i:03d}": "t4" + "\n\nagain\n\nt3" * 2 if i % 2 else "t0\n\nt1\n\nt2" for i in range(300)}
    got = {r.question_id: (r.context, r.n_parts) for r in recommendation.add_context(passages, chunks).collect()}
    assert {q: c for q, (c, _) in got.items()} == want and {n for _, n in got.values()} == {3, 5}
    prompts = recommendation.recommend(pending, passages, policies, lambda pdf: [{"rationale": p, "voting_recommendation": "For", "confidence": 1} for p in pdf["prompt"]],
                                       store_output=False, chunks=chunks)[0]
    said = {r.question_id: r.rationale.split("Passages:\n")[1].rsplit("\n\nRecommend", 1)[0] for r in prompts.collect()}
    assert said == {**want, "none": "", "far": ""}
    plan = prompts._jdf.queryExecution().sparkPlan().toString()
    calls = plan[plan.index("MapInPandas"):]
    assert "_texts" in calls[:calls.index("Join")]  # the join with the texts is the last one
