"""Column-wise filing index, directory, latest-per-meeting (FIXTURES C1, C2)."""

import json

import pytest
from pyspark.sql import functions as F

from filingflow.functions import forms
from filingflow.operators import latest
from filingflow.plans import proxy_ingest
from filingflow.sources import directory, filing_index

RECENT = {
    "accessionNumber": ["0000000001-22-000001", "0000000001-22-000002", "0000000001-22-000003",
                        "0000000001-22-000004", "0000000001-21-000009", "0000000001-22-000005",
                        "0000000001-22-000006"],
    "filingDate": ["2022-05-10", "2022-05-12", "2022-06-01", "2022-04-01", "2021-05-01", "2022-04-15", "2022-04-20"],
    "form": ["8-K", "8-K/A", "8-K", "DEF 14A", "8-K", "DEFA14A", "defr14a"],
    "items": ["5.07", "5.07,9.01", "2.02", None, "5.07", None, None],
    "primaryDocument": ["a.htm", None, "c.htm", "d.htm", "e.htm", "f.htm", "g.htm"],
    "meetingDate": ["2022-05-06", "2022-05-06", None, None, "2021-04-28", None, None],
}


@pytest.fixture(scope="module")
def index_dir(tmp_path_factory):
    d = tmp_path_factory.mktemp("index")
    main = {"cik": "1", "filings": {"recent": RECENT, "files": [
        {"name": "p1.json", "filingFrom": "2015-01-01", "filingTo": "2021-12-31"},
        {"name": "p2.json", "filingFrom": "2019-01-01", "filingTo": "2020-01-01"}]}}
    (d / "main.json").write_text(json.dumps(main))
    # an older page: top-level columns, no meetingDate column
    (d / "older.json").write_text(json.dumps({"accessionNumber": ["0000000001-18-000001"],
                                              "filingDate": ["2018-03-01"], "form": ["DEF 14A"],
                                              "primaryDocument": ["o.htm"]}))
    (d / "bad.json").write_text(json.dumps({"accessionNumber": ["x", "y", "z"], "form": ["8-K", "8-K"]}))
    return str(d)


def rows_and_rejects(spark, index_dir):
    raw = filing_index.read_index_files(spark, index_dir)
    pages = raw.select(F.coalesce("cik", F.lit("1")).alias("cik"), "source_file",
                       filing_index.page_struct(raw).alias("page"))
    return filing_index.index_rows(pages, ["cik", "source_file"])


def test_columnar_rows_and_rejects(spark, index_dir):
    rows, rej = rows_and_rejects(spark, index_dir)
    assert rows.count() == 8
    assert rej.count() == 1 and rej.first()["source_file"].endswith("bad.json")
    older = rows.where(F.col("accessionNumber") == "0000000001-18-000001").first()
    assert older["meetingDate"] is None and older["form"] == "DEF 14A"


def test_8k_and_proxy_selection_2022(spark, index_dir):
    rows, _ = rows_and_rejects(spark, index_dir)
    norm = filing_index.normalise(rows)
    y22 = norm.where(F.year("filing_date") == 2022)
    k8 = y22.where(forms.form_matches("form") & forms.items_include("items"))
    assert sorted(r["accessionNumber"][-2:] for r in k8.collect()) == ["01", "02"]
    prox = proxy_ingest.select_proxy_filings(norm, 2022)
    assert sorted(r["accession_number"][-2:] for r in prox.collect()) == ["04", "06"]
    r = prox.where(F.col("accession_number").endswith("04")).first()
    assert r["proxy_id"] == "0000000001_0000000001-22-000004"
    assert r["url"] == "https://www.sec.gov/Archives/edgar/data/1/000000000122000004/d.htm"


def _k8(spark, index_dir, default_first):
    rows, _ = rows_and_rejects(spark, index_dir)
    src = filing_index.normalise(rows) if default_first else rows
    return src.where(forms.form_matches("form") & forms.items_include("items")
                     & (F.substring("filingDate", 1, 4) == "2022"))


def test_latest_per_meeting_defaulted(spark, index_dir):
    k8 = _k8(spark, index_dir, True)
    got = latest.latest_nonnull(k8, ["cik", "meetingDate"], "accessionNumber",
                                ["accessionNumber", "primaryDocument"]).collect()
    assert [(r["accessionNumber"][-2:], r["primaryDocument"]) for r in got] == [("02", "primary_doc.htm")]


def test_latest_per_meeting_raw_parity_and_strict(spark, index_dir):
    k8 = _k8(spark, index_dir, False)
    par = latest.latest_nonnull(k8, ["cik", "meetingDate"], "accessionNumber",
                                ["accessionNumber", "primaryDocument"]).collect()
    assert [(r["accessionNumber"][-2:], r["primaryDocument"]) for r in par] == [("02", "a.htm")]
    strict = latest.latest_whole_row(k8, ["cik", "meetingDate"], ["filingDate", "accessionNumber"],
                                     ["accessionNumber", "primaryDocument"]).collect()
    assert [(r["accessionNumber"][-2:], r["primaryDocument"]) for r in strict] == [("02", None)]


def test_page_pruning_overlap(spark, index_dir):
    raw = filing_index.read_index_files(spark, index_dir).where(F.col("cik").isNotNull())
    kept = filing_index.older_pages_for_year(raw.select("cik", F.col("filings.files").alias("files")), ["cik"], 2018)
    assert [r["name"] for r in kept.collect()] == ["p1.json"]


def test_directory_last_wins(spark, tmp_path):
    p = tmp_path / "companies.json"
    p.write_text(json.dumps({"fields": ["cik", "name", "ticker", "exchange"], "data": [
        [1, "A One", "AONE", "X"], [1, "A Two", "ATWO", "Y"], [320193, "B", "B", "X"],
        ["12345678901", "Long", "L", "Z"]]}))
    d = directory.directory_rows(directory.read_directory_files(spark, str(p)))
    got = {r["cik"]: r["name"] for r in d.collect()}
    assert got == {"0000000001": "A Two", "0000320193": "B", "12345678901": "Long"}
    filings = spark.createDataFrame([("1",), ("320193",), ("7",)], "cik string")
    j = {r["cik"]: r["name"] for r in directory.with_company(filings, d).collect()}
    assert j == {"1": "A Two", "320193": "B", "7": None}


def test_key_helpers(spark):
    from filingflow.functions import keys
    df = spark.createDataFrame([("320193", "0000320193-24-000001", None, "", "x")],
                               "cik string, acc string, doc string, e string, f string")
    r = df.select(keys.object_key("filings", keys.pad_cik("cik"), F.col("acc"), keys.document_or_default("doc")).alias("k"),
                  keys.first_truthy("doc", "e", "f").alias("t"),
                  keys.first_truthy("e", F.lit("default")).alias("d")).first()
    assert r["k"] == "filings/0000320193/0000320193-24-000001/primary_doc.htm"
    assert (r["t"], r["d"]) == ("x", "default")


def test_chunk_handoff_files_roundtrip(spark, tmp_path):
    from filingflow.sources import handoff
    (tmp_path / "f1").mkdir()
    (tmp_path / "f2").mkdir()
    (tmp_path / "f1" / "chunks.json").write_text(json.dumps(
        [{"chunk_index": 0, "chunk_text": "a b", "embedding": [0.5, 0.5]},
         {"chunk_index": 1, "chunk_text": "c", "embedding": [1.0, 0.0]}]))
    (tmp_path / "f2" / "chunks.json").write_text(json.dumps(["x y", "z"]))
    rows = handoff.read_chunk_files(spark, str(tmp_path / "*" / "chunks.json"))
    got = sorted((r["filing_key"], r["chunk_index"], r["chunk_text"], r["embedding"]) for r in rows.collect())
    assert got == [("f1", 0, "a b", [0.5, 0.5]), ("f1", 1, "c", [1.0, 0.0]), ("f2", 0, "x y", None), ("f2", 1, "z", None)]
    back = handoff.chunks_as_json(rows.where(F.col("filing_key") == "f1"), "filing_key").first()["json"]
    assert json.loads(back) == [{"chunk_index": 0, "chunk_text": "a b", "embedding": [0.5, 0.5]},
                                {"chunk_index": 1, "chunk_text": "c", "embedding": [1.0, 0.0]}]


def test_empty_and_missing_pages(spark):
    pages = spark.createDataFrame([("a", {"form": []}), ("b", None)], "k string, page map<string, array<string>>") \
        .select("k", F.struct(*[F.col("page")[c].alias(c) for c in filing_index.INDEX_COLUMNS]).alias("page"))
    rows, rej = filing_index.index_rows(pages, ["k"])
    assert rows.count() == 0 and rej.count() == 0


def test_grouping_fallback_is_per_index_not_per_row(spark, tmp_path):
    from filingflow.plans import vote_extraction
    d = tmp_path / "idx2"
    d.mkdir()
    # company 1: meeting dates exist, one 8-K lacks it -> that one is dropped
    (d / "c1.json").write_text(json.dumps({"cik": "1", "filings": {"recent": {
        "accessionNumber": ["a1", "a2"], "filingDate": ["2022-05-10", "2022-06-10"], "form": ["8-K", "8-K"],
        "items": ["5.07", "5.07"], "primaryDocument": ["x.htm", "y.htm"], "meetingDate": ["2022-05-06", None]}}}))
    # company 2: no meetingDate column anywhere -> grouped by filing date
    (d / "c2.json").write_text(json.dumps({"cik": "2", "filings": {"recent": {
        "accessionNumber": ["b1", "b2"], "filingDate": ["2022-05-10", "2022-05-10"], "form": ["8-K", "8-K"],
        "items": ["5.07", "5.07"], "primaryDocument": ["x.htm", "y.htm"]}}}))
    raw = filing_index.read_index_files(spark, str(d))
    rows, _ = filing_index.index_rows(raw.select("cik", "source_file", filing_index.page_struct(raw).alias("page")),
                                      ["cik", "source_file"])
    jobs = spark.createDataFrame([("j1", "1", 2022), ("j2", "2", 2022)], "job_id string, cik string, year int")
    got = sorted((r["job_id"], str(r["group_date"]), r["accessionNumber"])
                 for r in vote_extraction.candidate_filings(jobs, filing_index.normalise(rows)).collect())
    assert got == [("j1", "2022-05-06", "a1"), ("j2", "2022-05-10", "b2")]
