"""Meeting feed selection (FIXTURES A and C3)."""

import json

import pytest
from pyspark.sql import functions as F

from filingflow.sources import meetings


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("feed")
    (d / "t1.json").write_text(json.dumps({"ticker": "T1", "companies": [
        {"isin": "I1", "meetings": [{"meetingId": "m1", "meetingDate": "2024-01-01"},
                                    {"meetingId": "m2", "meetingDate": "2024-03-01"},
                                    {"meetingId": "m3", "meetingDate": "2024-03-01"}]},
        {"isin": "I1", "meetings": [{"meetingId": "m9", "meetingDate": "2025-01-01"}]},
        {"isin": "I2", "meetings": []}]}))
    (d / "aapl.json").write_text(json.dumps({"ticker": "AAPL", "companies": [
        {"isin": "US0378331005", "meetings": [{"meetingId": "M1", "meetingDate": "2024-01-01"}]}]}))
    return meetings.feed_rows(meetings.read_feed(spark, str(d)))


REQ_SCHEMA = "request_id string, ticker string, isin string, n int, meeting_ids array<string>"


def test_newest_n_first_company_ties(spark, rows):
    req = spark.createDataFrame([("r1", "T1", "I1", 2, None)], REQ_SCHEMA).drop("meeting_ids")
    top, diag = meetings.list_meetings(req, rows)
    assert [r["meeting_id"] for r in top.orderBy("rank").collect()] == ["m2", "m3"]
    assert diag.count() == 0


def test_explicit_ids_and_diagnostics(spark, rows):
    req = spark.createDataFrame([("r1", "T1", "I1", None, ["m1"]), ("r2", "T1", "I2", 5, None),
                                 ("r3", "T1", "I3", 5, None), ("r4", "ZZ", "I1", 5, None)], REQ_SCHEMA)
    chosen, diag = meetings.select_meetings(req, rows)
    assert [(r["request_id"], r["meeting_id"]) for r in chosen.collect()] == [("r1", "m1")]
    assert sorted(r["request_id"] for r in diag.collect()) == ["r2", "r3", "r4"]
    _, d2 = meetings.list_meetings(req.where(F.col("request_id") != "r1").drop("meeting_ids"), rows)
    reasons = {r["request_id"]: r["reason"] for r in d2.collect()}
    assert reasons["r3"].startswith("No company of ticker") and reasons["r4"].startswith("No feed for ticker")


def test_default_five_and_validation(spark, rows):
    req = spark.createDataFrame([("a", "AAPL", "US0378331005", None, None), ("b", None, "X", None, None),
                                 ("c", "AAPL", "", None, None), ("d", "AAPL", "X", 0, None)], REQ_SCHEMA)
    good, bad = meetings.validate_requests(req)
    assert [r["request_id"] for r in good.collect()] == ["a"]
    assert {r["request_id"]: r["reject_reason"] for r in bad.collect()} == {
        "b": "ticker is required", "c": "isin is required", "d": "n must be at least 1"}
    top, _ = meetings.list_meetings(good.drop("meeting_ids"), rows)
    assert [r["meeting_id"] for r in top.collect()] == ["M1"]


def test_fetch_and_keyed_sink(spark, rows, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "M1.json").write_text(json.dumps({"meeting": "data"}))
    (docs / "m1.json").write_text(json.dumps({"status": "warning", "message": "Not found"}))
    req = spark.createDataFrame([("a", "AAPL", "US0378331005", 5, None), ("b", "T1", "I1", None, ["m1"])],
                                REQ_SCHEMA)
    chosen, _ = meetings.select_meetings(req, rows)
    good, bad = meetings.fetch_documents(chosen, meetings.read_meeting_documents(spark, str(docs)))
    assert [r["meeting_id"] for r in good.collect()] == ["M1"]
    assert [r["reject_reason"] for r in bad.collect()] == ["not found / warning payload"]
    out = tmp_path / "out"
    meetings.write_documents(good, str(out))
    assert (out / "security=AAPL_US0378331005").is_dir()
    back = spark.read.json(str(out)).collect()
    assert back[0]["meeting_id"] == "M1" and json.loads(back[0]["payload"]) == {"meeting": "data"}


def test_meetings_stored_one_after_the_other_all_stay(spark, tmp_path):
    schema = "ticker string, isin string, meeting_id string, payload string"
    for m, text in (("m1", "a"), ("m2", "b"), ("m1", "c")):
        meetings.write_documents(spark.createDataFrame([("T", "I", m, text)], schema), str(tmp_path / "out"))
    got = spark.read.json(str(tmp_path / "out")).collect()
    assert sorted((r["meeting_id"], r["payload"]) for r in got) == [("m1", "c"), ("m2", "b")]


def test_only_not_found_warnings_are_rejected(spark):
    chosen = spark.createDataFrame([(k, k) for k in "abcde"], "request_id string, meeting_id string")
    docs = spark.createDataFrame([("a", '{"status": "warning", "message": "Not found"}'), ("b", '{"status": "warning", "message": "late"}'),
                                  ("c", '{"status": "error", "message": "Not found"}'), ("d", '{"m": 1}')], "meeting_id string, payload string")
    good, bad = meetings.fetch_documents(chosen, docs)
    assert sorted(r["meeting_id"] for r in good.collect()) == ["b", "c", "d"]
    assert sorted((r["meeting_id"], r["reject_reason"]) for r in bad.collect()) == [("a", "not found / warning payload"), ("e", "document missing")]


def test_e3_fetch_plan(spark, rows, tmp_path):
    from filingflow.plans import meeting_fetch
    feed_dir = tmp_path / "feed"
    feed_dir.mkdir()
    (feed_dir / "t.json").write_text(json.dumps({"ticker": "AAPL", "companies": [
        {"isin": "US0378331005", "meetings": [{"meetingId": "M1", "meetingDate": "2024-01-01"},
                                              {"meetingId": "M2", "meetingDate": "2023-01-01"}]}]}))
    docs = spark.createDataFrame([("M1", '{"meeting": "data"}')], "meeting_id string, payload string")
    req = spark.createDataFrame([("a", "AAPL", "US0378331005", 5, None), ("b", None, "X", None, None)], REQ_SCHEMA)
    out, diag = meeting_fetch.fetch(req, meetings.read_feed(spark, str(feed_dir)), docs, str(tmp_path / "out"))
    assert [r["meeting_id"] for r in out.collect()] == ["M1"]
    reasons = sorted(r["reason"] for r in diag.collect())
    assert reasons == ["document missing: M2", "ticker is required"]
    assert (tmp_path / "out" / "security=AAPL_US0378331005").is_dir()


def test_tasks_facade_meetings(spark, tmp_path):
    from filingflow import tasks
    feed = tmp_path / "feed"
    feed.mkdir()
    (feed / "t.json").write_text(json.dumps({"ticker": "AAPL", "companies": [
        {"isin": "US0378331005", "meetings": [{"meetingId": "M1", "meetingDate": "2024-01-01"}]}]}))
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "M1.json").write_text(json.dumps({"meeting": "data"}))
    req = spark.createDataFrame([("a", "AAPL", "US0378331005", 3, None), ("b", "AAPL", None, 3, None)], REQ_SCHEMA)
    found, diag = tasks.list_meetings(spark, str(feed), req.drop("meeting_ids"))
    assert [r["meeting_id"] for r in found.collect()] == ["M1"]
    assert [r["reason"] for r in diag.collect()] == ["isin is required"]
    out, diag2 = tasks.fetch_meetings(spark, str(feed), str(docs), req, str(tmp_path / "out"))
    assert [r["meeting_id"] for r in out.collect()] == ["M1"] and diag2.count() == 1


def test_first_company_hides_later_ones_even_without_meetings(spark):
    feed = spark.createDataFrame([("T", [("I", []), ("I", [("m1", "2024-01-01")])]),
                                  ("U", [("J", [("a", "2024-01-01"), ("b", None), (None, None), ("c", "2025-01-01")]), ("J", [("z", "2026-01-01")])]),
                                  ("V", None)], meetings.FEED_SCHEMA)
    req = spark.createDataFrame([("r1", "T", "I", 3), ("r2", "U", "J", 4), ("r3", "U", "J", 1), ("r4", "V", "I", 1), (None, "U", "J", 1)],
                                "request_id string, ticker string, isin string, n int")
    top, diag = meetings.list_meetings(req, meetings.feed_rows(feed))
    assert sorted((r.request_id, r["rank"], r.meeting_id) for r in top.where("request_id is not null").collect()) == [
        ("r2", 1, "c"), ("r2", 2, "a"), ("r2", 3, "b"), ("r3", 1, "c")]
    # a request without an id can't be matched with its meetings
    assert sorted((r.request_id or "", r.ticker) for r in diag.collect()) == [("", "U"), ("r1", "T"), ("r4", "V")]


def test_feed_and_requests_are_worked_through_once(spark, tmp_path):
    """results and diagnostics read stored rows, not the feed, the requests and the documents once each."""
    from filingflow.plans import meeting_fetch
    for name, rows in (("feed", [{"ticker": "T", "companies": [{"isin": "I", "meetings": [{"meetingId": "m", "meetingDate": "2024-01-01"}]}]}]),
                       ("requests", [{"request_id": "r", "ticker": "T", "isin": "I", "n": 1}, {"request_id": "s", "ticker": "X", "isin": "I", "n": 1},
                                     {"request_id": "t", "ticker": "T", "isin": None, "n": 1}]),
                       ("documents", [{"meeting_id": "m", "payload": "{}"}])):
        (tmp_path / f"{name}.json").write_text("\n".join(map(json.dumps, rows)))
    feed = meetings.read_feed(spark, str(tmp_path / "feed.json"), lines=True)
    req = spark.read.schema("request_id string, ticker string, isin string, n int").json(str(tmp_path / "requests.json"))
    docs = spark.read.schema("meeting_id string, payload string").json(str(tmp_path / "documents.json"))
    out, diag = meeting_fetch.fetch(req, feed, docs)
    for df in (out, diag):
        assert "] json" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.request_id, r.meeting_id) for r in out.collect()] == [("r", "m")]
    assert sorted((r.request_id, r.reason) for r in diag.collect()) == [("s", "no meetings found"), ("t", "isin is required")]
