"""Job queue and status life cycles (FIXTURES C9)."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from filingflow.operators import status
from filingflow.streaming import jobs


def test_current_status_and_transitions(spark):
    log = spark.createDataFrame([
        ("a", "pending", None, 1), ("a", "running", None, 2), ("a", "done", None, 3),
        ("b", "pending", None, 1), ("b", "running", None, 2), ("b", "error", "x", 3),
        ("c", "running", None, 1)], "id string, status string, error string, seq int")
    cur = {r["id"]: (r["status"], r["error"]) for r in
           status.current_status(log, ["id"], ["seq"], ["status", "error"]).collect()}
    assert cur == {"a": ("done", None), "b": ("error", "x"), "c": ("running", None)}
    bad = status.illegal_transitions(log, ["id"], "seq", "status", status.JOB_TRANSITIONS)
    assert [r["id"] for r in bad.collect()] == ["c"]


def test_stream_replay_adds_nothing(spark, tmp_path):
    incoming, state = tmp_path / "in", tmp_path / "state"
    incoming.mkdir()
    reqs = [{"id": "j1", "params": json.dumps({"n": 2}), "created_at": "2024-01-01T00:00:00"},
            {"id": "j2", "params": json.dumps({"n": 3}), "created_at": "2024-01-01T00:00:01"}]
    (incoming / "a.json").write_text("\n".join(json.dumps(r) for r in reqs))

    def process(todo):
        p = todo.select("job_id", F.get_json_object("params", "$.n").cast("int").alias("n"))
        return p.select("job_id", F.explode(F.sequence(F.lit(1), "n")).alias("i"))

    for _ in range(2):  # the second run sees the same file again
        q = jobs.start_worker(spark, str(incoming), str(state), process, available_now=True)
        q.awaitTermination()
    cur = {r["job_id"]: r["status"] for r in jobs.current_jobs(spark, str(state)).collect()}
    assert cur == {"j1": "done", "j2": "done"}
    assert jobs.job_results(spark, str(state)).count() == 5
    # the same request re-delivered under a new file name is skipped as done
    (incoming / "b.json").write_text(json.dumps(reqs[0]))
    q = jobs.start_worker(spark, str(incoming), str(state), process, available_now=True)
    q.awaitTermination()
    assert jobs.job_results(spark, str(state)).count() == 5


def test_oldest_pending(spark, tmp_path):
    req = spark.createDataFrame([("b", "{}", dt.datetime(2024, 1, 1)), ("a", "{}", dt.datetime(2024, 1, 1)),
                                 ("c", "{}", dt.datetime(2023, 1, 1))], "id string, params string, created_at timestamp")
    got = jobs.oldest_pending_job(spark, req, str(tmp_path / "none"), 2).collect()
    assert [r["id"] for r in got] == ["c", "a"]


def test_failed_questions_stay_pending(spark):
    from filingflow.plans import recommendation
    qs = spark.createDataFrame([(1, "1a", "q", "NEW"), (1, "1b", "q", "NEW"), (1, "1c", "q", "NEW")],
                               "filing_id long, question_id string, question_text string, status string")
    fil = spark.createDataFrame([(1, "Co", None)], "filing_id long, company_name string, filing_date date")
    log = spark.createDataFrame([
        *[(1, "1a", "ERROR", k) for k in range(1, 6)],
        (1, "1b", "ERROR", 1), (1, "1c", "DONE", 1)], "filing_id long, question_id string, status string, seq long")
    got = recommendation.pending_questions(qs, fil, log)
    assert sorted(r["question_id"] for r in got.collect()) == ["1a", "1b"]


def test_recommendation_worker_retries_errors(spark, tmp_path):
    from filingflow.operators import model
    from filingflow.streaming import recommendations as worker
    qdir, state = str(tmp_path / "questions"), str(tmp_path / "state")
    qschema = ("filing_id long, question_id string, question_text string, status string, "
               "question_embedding array<float>")
    spark.createDataFrame([(1, "1", "Elect A?", "NEW", [1.0, 0.0]), (1, "2", "Pay B?", "NEW", [0.0, 1.0])],
                          qschema).write.mode("append").parquet(qdir)
    filings = spark.createDataFrame([(1, "Co", None, 0)], "filing_id long, company_name string, "
                                                          "filing_date date, policy_id int")
    chunks = spark.createDataFrame([(1, 0, "alpha text", [1.0, 0.0]), (1, 1, "beta text", [0.0, 1.0])],
                                   "filing_id long, chunk_index int, chunk_text string, embedding array<float>")
    policies = spark.createDataFrame([(0, "Rule.")], "policy_id int, policy_rules string")
    switch = tmp_path / "fail-question-2"
    switch.touch()

    def flaky(pdf):
        # question 2 fails while the switch file exists (checked on the worker)
        import os
        out = []
        for qid in pdf["question_id"]:
            if qid == "2" and os.path.exists(str(switch)):
                raise RuntimeError("model timeout")
            out.append('{"question_id": "%s", "voting_recommendation": "For", "confidence": 0.9}' % qid)
        return out

    def current():
        return {r["question_id"]: (r["status"], r["error_msg"]) for r in
                status.current_status(worker.status_log(spark, state), ["filing_id", "question_id"], ["seq"],
                                      ["status", "error_msg"]).collect()}

    worker.start(spark, qdir, state, filings, chunks, policies, flaky, qschema, available_now=True) \
        .awaitTermination()
    first = current()
    assert first["1"] == ("DONE", None) and first["2"][0] == "ERROR" and "timeout" in first["2"][1]
    assert worker.compact_status(spark, state) == 0  # later batches read the snapshot
    switch.unlink()
    # a new question file arrives; its batch also retries question 2
    spark.createDataFrame([(1, "3", "Ratify C?", "NEW", [1.0, 1.0])], qschema).write.mode("append").parquet(qdir)
    worker.start(spark, qdir, state, filings, chunks, policies, flaky, qschema, available_now=True) \
        .awaitTermination()
    assert {k: v[0] for k, v in current().items()} == {"1": "DONE", "2": "DONE", "3": "DONE"}
    recs = {r["question_id"]: r["voting_recommendation"] for r in worker.current_recommendations(spark, state).collect()}
    assert recs == {"1": "For", "2": "For", "3": "For"}


def test_vote_jobs_through_the_queue(spark, tmp_path):
    from filingflow.operators import model
    from filingflow.plans import vote_extraction
    from filingflow.sources import filing_index
    idx = filing_index.normalise(spark.createDataFrame(
        [("1", "0000000001-22-000001", "2022-05-10", "8-K", "5.07", "a.htm", "2022-05-06"),
         ("2", "0000000002-22-000001", "2022-05-10", "8-K", "5.07", "b.htm", "2022-05-07")],
        "cik string, accessionNumber string, filingDate string, form string, items string, "
        "primaryDocument string, meetingDate string"))
    base = "https://www.sec.gov/Archives/edgar/data"
    docs = spark.createDataFrame([(f"{base}/1/000000000122000001/a.htm", "<p>ITEM 5.07 Votes. For all.</p>"),
                                  (f"{base}/2/000000000222000001/b.htm", "<p>Other news.</p>")],
                                 "url string, html string")
    companies = spark.createDataFrame([("1", "AAA"), ("2", "BBB")], "cik string, ticker string")
    incoming, state = tmp_path / "in", tmp_path / "state"
    incoming.mkdir()
    reqs = [{"id": "j1", "params": json.dumps({"cik": "1", "year": 2022}), "created_at": "2024-01-01T00:00:00"},
            {"id": "j2", "params": json.dumps({"cik": "2", "year": 2022}), "created_at": "2024-01-01T00:00:01"}]
    (incoming / "a.json").write_text("\n".join(json.dumps(r) for r in reqs))
    proc = vote_extraction.job_processor(idx, docs, companies, model.stub_tally_model("prompt", "ticker", "meeting_date"))
    jobs.start_worker(spark, str(incoming), str(state), proc, available_now=True).awaitTermination()
    cur = {r["job_id"]: r["status"] for r in jobs.current_jobs(spark, str(state)).collect()}
    assert cur == {"j1": "done", "j2": "done"}
    res = jobs.job_results(spark, str(state))
    assert res.where(F.col("job_id") == "j1").count() >= 1 and res.where(F.col("job_id") == "j2").count() == 0


def test_tasks_facade_vote_jobs(spark, tmp_path):
    from filingflow import tasks
    from filingflow.operators import model
    idx_dir = tmp_path / "index"
    idx_dir.mkdir()
    (idx_dir / "c1.json").write_text(json.dumps({"cik": "1", "filings": {"recent": {
        "accessionNumber": ["0000000001-22-000001"], "filingDate": ["2022-05-10"], "form": ["8-K"],
        "items": ["5.07"], "primaryDocument": ["a.htm"], "meetingDate": ["2022-05-06"]}}}))
    docs = spark.createDataFrame([("https://www.sec.gov/Archives/edgar/data/1/000000000122000001/a.htm",
                                   "<p>Item 5.07 Results. Approved.</p>")], "url string, html string")
    companies = spark.createDataFrame([("1", "AAA")], "cik string, ticker string")
    incoming, state = str(tmp_path / "in"), str(tmp_path / "state")
    sub = tasks.submit_vote_jobs(spark, incoming, [("1", 2022), ("1", 2021)])
    ids = sorted(r["id"] for r in sub.collect())
    tasks.run_vote_worker(spark, incoming, state, str(idx_dir), docs, companies,
                          model.stub_tally_model("prompt", "ticker", "meeting_date"))
    st = {r["job_id"]: r["status"] for r in tasks.job_status(spark, state).collect()}
    # one of the two years has no Item 5.07 filing: an error with its reason
    assert sorted(st) == ids and sorted(st.values()) == ["done", "error"]
    errors = [r["error"] for r in tasks.job_status(spark, state).collect() if r["error"]]
    assert errors == ["no Item 5.07 filing of 1 in 2021"]
    assert tasks.job_results(spark, state).count() >= 1


def test_failed_batch_marks_jobs_error_and_stream_continues(spark, tmp_path):
    incoming, state = tmp_path / "in", tmp_path / "state"
    incoming.mkdir()
    (incoming / "a.json").write_text(json.dumps({"id": "j1", "params": "{}", "created_at": "2024-01-01T00:00:00"}))

    def broken(todo):
        raise ValueError("index unavailable")

    jobs.start_worker(spark, str(incoming), str(state), broken, available_now=True).awaitTermination()
    cur = {r["job_id"]: (r["status"], r["error"]) for r in jobs.current_jobs(spark, str(state)).collect()}
    assert cur["j1"][0] == "error" and "index unavailable" in cur["j1"][1]


def test_model_may_return_objects(spark):
    from filingflow.operators import model
    df = spark.createDataFrame([(1, "x")], "id int, t string")
    out = model.apply_model(df, lambda pdf: [{"a": 1}] * len(pdf), ["t"], ["id"]).first()
    assert json.loads(out["model_output"]) == {"a": 1} and out["model_error"] is None


def test_incremental_ingest_stream(spark, tmp_path):
    from filingflow.streaming import ingest
    words = " ".join(f"w{i}." if i % 9 == 8 else f"w{i}" for i in range(900))
    base = "https://www.sec.gov/Archives/edgar/data/1"
    docs = spark.createDataFrame([(f"{base}/{a}/d.htm", f"<p>{words}</p>")
                                  for a in ("000000000122000001", "000000000122000002", "000000000122000003")],
                                 "url string, html string")
    idx, state = tmp_path / "idx", str(tmp_path / "state")
    idx.mkdir()

    def page(accs):
        return json.dumps({"cik": "1", "filings": {"recent": {
            "accessionNumber": accs, "filingDate": ["2022-04-01"] * len(accs), "form": ["DEF 14A"] * len(accs),
            "primaryDocument": ["d.htm"] * len(accs)}}})

    def run(redo=None):
        ingest.start(spark, str(idx), state, docs, 2022, redo=redo, available_now=True).awaitTermination()

    (idx / "p1.json").write_text(page(["0000000001-22-000001", "0000000001-22-000002"]))
    (idx / "p1b.json").write_text(page(["0000000001-22-000001"]))  # overlapping page, same batch
    run()
    (idx / "p2.json").write_text(page(["0000000001-22-000002", "0000000001-22-000003"]))
    run()
    cur = {r["proxy_id"][-2:]: r["batch_id"] for r in ingest.stored_filings(spark, state).collect()}
    assert cur == {"01": 0, "02": 0, "03": 1}  # 02 was delivered again and skipped
    assert ingest.compact_filings(spark, state) == 1
    redo = spark.createDataFrame([("0000000001_0000000001-22-000001",)], "proxy_id string")
    (idx / "p3.json").write_text(page(["0000000001-22-000001"]))
    run(redo)
    cur = {r["proxy_id"][-2:]: r["batch_id"] for r in ingest.stored_filings(spark, state).collect()}
    assert cur == {"01": 2, "02": 0, "03": 1}
    ch = ingest.stored_chunks(spark, state)
    assert ch.count() == 3 * 2  # two windows per filing, the re-ingested one counted once


def test_status_log_compaction(spark, tmp_path):
    incoming, state = tmp_path / "in", tmp_path / "state"
    incoming.mkdir()

    def process(todo):
        return todo.select("job_id", F.lit(1).alias("x"))

    for i in range(3):
        (incoming / f"r{i}.json").write_text(json.dumps({"id": f"j{i}", "params": "{}",
                                                         "created_at": "2024-01-01T00:00:00"}))
        jobs.start_worker(spark, str(incoming), str(state), process, available_now=True).awaitTermination()
        if i == 1:
            assert jobs.compact_status(spark, str(state)) == 1
    rows = jobs.read_status(spark, str(state))
    # snapshot: one row per job up to batch 1; log: both rows of batch 2
    assert rows.count() == 2 + 2
    cur = {r["job_id"]: r["status"] for r in jobs.current_jobs(spark, str(state)).collect()}
    assert cur == {"j0": "done", "j1": "done", "j2": "done"}
    assert jobs.job_results(spark, str(state)).count() == 3


@pytest.mark.parametrize("compacted", [False, True])
def test_replayed_job_batch_does_the_same_again(spark, tmp_path, compacted):
    state = str(tmp_path)
    made = []

    def process(todo):
        made.append(todo.count())
        return todo.select("job_id", F.length("params").alias("n"))
    handle = jobs.make_batch_handler(state, process)
    batch = spark.createDataFrame([(f"j{i}", "{}", dt.datetime(2024, 1, 1)) for i in range(2)], "id string, params string, created_at timestamp")
    handle(batch, 0)
    if compacted:
        jobs.compact_status(spark, state)
    before = jobs.job_results(spark, state).count(), jobs.current_jobs(spark, state).count()
    handle(batch, 0)
    assert (jobs.job_results(spark, state).count(), jobs.current_jobs(spark, state).count()) == before == (2, 2)
    assert made == [2, 2]
    handle(batch, 1)  # delivered again later: skipped
    assert made == [2, 2, 0] and jobs.job_results(spark, state).count() == 2


def test_replayed_ingest_batch_keeps_its_filings(spark, tmp_path):
    from filingflow.plans import proxy_ingest
    from filingflow.sources import filing_index
    from filingflow.streaming import ingest
    index, state = tmp_path / "index", str(tmp_path / "state")
    index.mkdir()
    (index / "a.json").write_text(json.dumps({"cik": "1", "filings": {"recent": {
        "accessionNumber": ["A-1"], "filingDate": ["2024-01-02"], "form": ["DEF 14A"], "primaryDocument": ["d.htm"]}}}))
    batch = spark.read.schema(filing_index.INDEX_FILE_SCHEMA).option("multiLine", True).json(str(index)) \
        .withColumn("source_file", F.lit("a.json"))
    pages = batch.select("cik", "source_file", filing_index.page_struct(batch).alias("page"))
    url = proxy_ingest.select_proxy_filings(filing_index.normalise(filing_index.index_rows(pages, ["cik", "source_file"])[0])).first()["url"]
    docs = spark.createDataFrame([(url, "<p>" + "word " * 900 + "</p>")], "url string, html string")
    handle = ingest.make_handler(state, docs)
    for _ in range(2):
        handle(batch, 0)
        assert ingest.stored_filings(spark, state).count() == 1 and ingest.stored_chunks(spark, state).count() == 2


def test_replayed_recommendation_batch_keeps_its_results(spark, tmp_path):
    from filingflow.operators import model
    from filingflow.streaming import recommendations as worker
    qdir, state = str(tmp_path / "questions"), str(tmp_path / "state")
    questions = spark.createDataFrame([(1, "1", "Elect A?", "NEW", [1.0, 0.0])],
                                      "filing_id long, question_id string, question_text string, status string, question_embedding array<float>")
    questions.write.parquet(qdir)
    filings = spark.createDataFrame([(1, "Co", None, 0)], "filing_id long, company_name string, filing_date date, policy_id int")
    chunks = spark.createDataFrame([(1, 0, "text", [1.0, 0.0])], "filing_id long, chunk_index int, chunk_text string, embedding array<float>")
    policies = spark.createDataFrame([(0, "Rule.")], "policy_id int, policy_rules string")
    handle = worker.make_handler(qdir, state, filings, chunks, policies, model.stub_recommendation_model())
    for _ in range(2):
        handle(spark.read.parquet(qdir), 0)
        got = worker.current_recommendations(spark, state).collect()
        assert len(got) == 1 and got[0]["policy_breaches"] == "none"
        assert worker.status_log(spark, state).count() == 1


def test_index_pages_that_cannot_be_read_are_reported(spark, tmp_path):
    from filingflow import tasks
    from filingflow.operators import model
    idx_dir = tmp_path / "index"
    idx_dir.mkdir()
    page = {"accessionNumber": ["0000000001-22-000001"], "filingDate": ["2022-05-10"], "form": ["8-K"],
            "items": ["5.07"], "primaryDocument": ["a.htm"], "meetingDate": ["2022-05-06"]}
    (idx_dir / "c1.json").write_text(json.dumps({"cik": "1", "filings": {"recent": page}}))
    (idx_dir / "c1-old.json").write_text(json.dumps({"cik": "1", **page, "form": []}))
    (idx_dir / "c2.json").write_text(json.dumps({"cik": "2", "filings": {"recent": {**page, "items": ["5.07", "9.01"]}}}))
    docs = spark.createDataFrame([("https://www.sec.gov/Archives/edgar/data/1/000000000122000001/a.htm",
                                   "<p>Item 5.07 Results. Approved.</p>")], "url string, html string")
    companies = spark.createDataFrame([("1", "AAA")], "cik string, ticker string")
    incoming, state = str(tmp_path / "in"), str(tmp_path / "state")
    submitted = tasks.submit_vote_jobs(spark, incoming, [("1", 2022), ("2", 2022), ("3", 2022)])
    job = {json.loads(r.params)["cik"]: r.id for r in submitted.collect()}
    tasks.run_vote_worker(spark, incoming, state, str(idx_dir), docs, companies,
                          model.stub_tally_model("prompt", "ticker", "meeting_date"))
    cur = {r["job_id"]: (r["status"], r["error"]) for r in tasks.job_status(spark, state).collect()}
    assert cur[job["1"]][0] == "error" and cur[job["1"]][1].endswith("c1-old.json: unequal column lengths")
    assert cur[job["2"]][0] == "error" and cur[job["2"]][1].endswith("c2.json: unequal column lengths")
    assert "no Item 5.07 filing" in cur[job["3"]][1]
    assert [r["status"] for r in tasks.job_status(spark, state, job["2"]).collect()] == ["error"]
    assert tasks.job_status(spark, state, "no such job").count() == 0
    # what the readable page holds is stored all the same
    assert tasks.job_results(spark, state, job["1"]).where("error is null").count() >= 1
    rejects = spark.read.parquet(f"{state}/rejects").collect()
    assert sorted(r.source_file.rsplit("/", 1)[1] for r in rejects) == ["c1-old.json", "c2.json"]
    stored = spark.createDataFrame([], "proxy_id string")
    filings, _, rejects = tasks.ingest_proxy_statements(spark, str(idx_dir), docs, stored, 2022)
    assert sorted((r.cik, r.proxy_id.rsplit("/", 1)[1], r.reject_reason) for r in rejects.collect()) == [
        ("0000000001", "c1-old.json", "unequal column lengths"), ("0000000002", "c2.json", "unequal column lengths")]
