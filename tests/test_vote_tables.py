"""Vote tables read from page markup, and the worker that stores them."""

import json
import random

import pytest
from pyspark.sql import functions as F

from filingflow import tasks
from filingflow.functions.html_tables import page_grids
from filingflow.operators import vote_tables
from filingflow.plans import vote_extraction
from filingflow.sources import filing_index


def grids(page):
    return [t["rows"] for t in page_grids(page)]


def test_random_tilings_come_back_as_they_were_drawn():
    rnd = random.Random(7)
    for _ in range(200):
        height, width = rnd.randint(1, 6), rnd.randint(1, 6)
        want = [[None] * width for _ in range(height)]
        rows = []
        for r in range(height):
            cells = []
            for c in range(width):
                if want[r][c] is not None:
                    continue
                across = 1
                while c + across < width and want[r][c + across] is None and rnd.random() < .4:
                    across += 1
                down = rnd.randint(1, height - r)
                for i in range(r, r + down):
                    want[i][c:c + across] = [f"{r}.{c}"] * across
                tag = rnd.choice(["td", "th", "TD"])
                span = 0 if r + down == height and rnd.random() < .5 else down
                cells.append(f'<{tag} rowspan="{span}" colspan={across}> {r}.{c}\n' + rnd.choice(["", f"</{tag}>"]))
            rows.append("<tr>" + "".join(cells) + rnd.choice(["", "</tr>"]))
        assert grids("<p>x<table>" + "".join(rows) + "</table>y") == [want]


def test_markup_that_is_not_as_it_should_be():
    assert grids("") == grids("no markup") == grids("<table></table>") == []
    assert grids("<table><tr><td>a<td>b") == [[["a", "b"]]]
    assert grids("<table><td>a</td></table>") == [[["a"]]]
    assert grids('<table><tr><td title="x > y">a &amp; b<br>c<script>d</script></td></tr></table>') == [[["a & b c"]]]
    assert grids("<table><tr><td colspan=two>a</td><td rowspan=-1>b</td></tr></table>") == [[["a", "b"]]]
    # an inner table is its own, in document order, and the outer cell goes on behind it
    assert grids("<table><tr><td>a<table><tr><td>in</table>z</td><td>b</table>") == [[["az", "b"]], [["in"]]]
    assert grids("</table></td><table><tr></tr><tr><td>a</table>") == [[[], ["a"]]]


@pytest.fixture(scope="module")
def read(spark):
    def run(*pages):
        df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "id int, html string")
        good, bad = vote_tables.page_tallies(df, ["id"])
        return good.orderBy("id", "table_no", "row_no").collect(), bad.collect()
    return run


def test_directors_and_proposals(read):
    page = """<table><tr><th>Nominee<th>For<th>Withheld<th>Broker Non-Votes</tr>
      <tr><td colspan=4>Vote for the directors of Class I</td></tr>
      <tr><td>1. A. Director</td><td>1,200,300 (95.1%)</td><td>34,000*</td><td rowspan=2>5,000</td></tr>
      <tr><td>B. Director</td><td>12</td><td>&#8212;</td></tr></table>
      <table><tr><td></td><td>FOR</td><td>AGAINST</td><td>ABSTAIN</td><td>Broker non votes</td><td>Total</td></tr>
      <tr><td>Item No. 2a Auditor</td><td>$ 1</td><td>2</td><td>3</td><td>0</td><td>7</td></tr></table>"""
    good, bad = read(page)
    assert bad == []
    assert [(r.question_id, r.resolution, r.for_votes, r.against_votes, r.abstentions, r.broker_non_votes) for r in good] == [
        ("1", "1. A. Director", 1200300, 34000, None, 5000), ("1.2", "B. Director", 12, None, None, 5000),
        ("2a", "Item No. 2a Auditor", 1, 2, 3, 0)]
    assert [(r.total_votes, r.computed_total, r.total_mismatch) for r in good] == [
        (None, None, False), (None, None, False), (7, 6, True)]


def test_other_tables_counts_that_are_none_and_pages_without_text(read):
    accounts = "<table><tr><td>Year<td>Total</tr><tr><td>Sales<td>1,000</tr></table>"
    no_header = "<table><tr><td>1<td>2<td>3</tr></table>"
    odd = "<table><tr><td>P<td>For<td>Against</tr><tr><td>a<td>1<td>2</tr><tr><td>b<td>12,34<td>2</tr><tr><td>c<td>9999999999999999999<td>2</tr></table>"
    good, bad = read(None, "", accounts, no_header, odd, odd)
    assert [(r.id, r.resolution, r.for_votes) for r in good] == [(4, "a", 1), (5, "a", 1)]
    assert sorted((r.id, r.resolution, r.reject_reason, r.against_votes) for r in bad) == [
        (i, x, "bad for_votes", 2) for i in (4, 5) for x in "bc"]


def test_no_pages_and_a_very_long_table(spark, read):
    none = spark.createDataFrame([], "id int, html string")
    assert [df.count() for df in vote_tables.page_tallies(none, ["id"])] == [0, 0]
    rows = "".join(f"<tr><td>n{i}<td>{i}<td>{i}" for i in range(20_000))
    good, bad = read("<table><tr><th>Name<th>For<th>Against</tr>" + rows + "</table>")
    assert bad == [] and len(good) == 20_000 and sum(r.for_votes for r in good) == sum(range(20_000))


def test_rows_do_not_shuffle(spark):
    df = spark.createDataFrame([(1, "<p>")], "id int, html string")
    good, _ = vote_tables.page_tallies(df, ["id"])
    assert "Exchange" not in good._jdf.queryExecution().executedPlan().toString()


VOTES = "<h1>Item 5.07 votes</h1><table><tr><td>P<td>For<td>Against</tr><tr><td>Proposal 1<td>{a}<td>2</tr><tr><td>Proposal 2<td>{b}<td>4</tr></table>"


def test_worker_stores_votes_and_results(spark, tmp_path):
    idx, incoming, state = tmp_path / "index", str(tmp_path / "in"), str(tmp_path / "state")
    idx.mkdir()
    def page(acc, day, doc):
        return {"accessionNumber": [acc], "filingDate": [day], "form": ["8-K"], "items": ["5.07"],
                "primaryDocument": [doc], "meetingDate": [day]}
    # the filing of 2021 is on an older page that names no company
    (idx / "CIK1.json").write_text(json.dumps({"cik": "1", "filings": {
        "recent": page("0000000001-22-000001", "2022-05-10", "a.htm"),
        "files": [{"name": "CIK1-older.json", "filingFrom": "2019-01-01", "filingTo": "2021-12-31"}]}}))
    (idx / "CIK1-older.json").write_text(json.dumps(page("0000000001-21-000001", "2021-05-10", "b.htm")))
    (idx / "lost.json").write_text(json.dumps(page("0000000009-21-000001", "2021-05-10", "c.htm")))
    base = "https://www.sec.gov/Archives/edgar/data/1"
    docs = spark.createDataFrame([(f"{base}/000000000122000001/a.htm", VOTES.format(a=1, b=3)),
                                  (f"{base}/000000000121000001/b.htm", VOTES.format(a=10, b="all"))], "url string, html string")
    companies = spark.createDataFrame([("1", "AAA")], "cik string, ticker string")
    first = tasks.submit_vote_jobs(spark, incoming, [("1", 2022)]).collect()[0].id
    assert [(r.status, r.result) for r in tasks.job_lookup(spark, incoming, state, first).collect()] == [("pending", None)]
    tasks.run_vote_worker(spark, incoming, state, str(idx), docs, companies)
    found = tasks.job_lookup(spark, incoming, state, first).collect()[0]
    assert found.status == "done" and found.created_at is not None
    assert [(v["question_id"], v["for_votes"], v["against_votes"]) for v in json.loads(found.result)] == [("1", 1, 2), ("2", 3, 4)]
    # the same company and year again adds no votes, another year does; its bad count is the job's error
    (tmp_path / "in" / "again.json").write_text("\n".join(json.dumps(
        {"id": i, "params": json.dumps({"cik": "1", "year": y}), "created_at": "2024-01-01T00:00:00"})
        for i, y in (("j2", 2022), ("j3", 2021))))
    tasks.run_vote_worker(spark, incoming, state, str(idx), docs, companies)
    votes = tasks.stored_votes(spark, state).orderBy("meeting_date", "question_id").collect()
    assert [(v.cik, v.ticker, v.meeting_date, v.question_id, v.for_votes, v.resolution) for v in votes] == [
        ("0000000001", "AAA", "2021-05-10", "1", 10, "Proposal 1"), ("0000000001", "AAA", "2022-05-10", "1", 1, "Proposal 1"),
        ("0000000001", "AAA", "2022-05-10", "2", 3, "Proposal 2")]
    assert json.loads(votes[0].raw_json)["for"] == 10
    got = {r.job_id: (r.status, r.error, r.result) for r in tasks.job_lookup(spark, incoming, state).collect()}
    assert got["j2"][0] == "done" and json.loads(got["j2"][2]) == json.loads(found.result)
    assert got["j3"] == ("error", "bad for_votes", None)
    # a batch that runs again under its id stores the same once more
    again = tasks.job_results(spark, state).where("error is null")
    vote_extraction.vote_store(state)(again, 1)
    assert tasks.stored_votes(spark, state).count() == 3
    rejects = spark.read.parquet(f"{state}/rejects").collect()
    assert [(r.source_file.rsplit("/", 1)[1], r.reason) for r in rejects] == [("lost.json", "page of no listed company")]


def test_a_batch_whose_votes_cannot_be_stored_fails_and_runs_again(spark, tmp_path):
    from pyspark.errors import StreamingQueryException

    from filingflow.streaming import jobs
    incoming, state = tmp_path / "in", str(tmp_path / "state")
    incoming.mkdir()
    (incoming / "a.json").write_text(json.dumps({"id": "j", "params": "{}", "created_at": "2024-01-01T00:00:00"}))
    def process(todo):
        return todo.select("job_id", F.lit(1).alias("x"))
    def full(results, batch_id):
        raise OSError("no space")
    with pytest.raises(StreamingQueryException):
        jobs.start_worker(spark, str(incoming), state, process, available_now=True, store=full).awaitTermination()
    assert [r.status for r in jobs.lookup(spark, str(incoming), state).collect()] == ["running"]
    kept = []
    jobs.start_worker(spark, str(incoming), state, process, available_now=True,
                      store=lambda r, b: kept.append((b, r.count()))).awaitTermination()
    assert kept == [(0, 1)] and [r.status for r in jobs.lookup(spark, str(incoming), state).collect()] == ["done"]


def test_older_pages_by_year(spark, tmp_path):
    def page(n):
        return {"accessionNumber": [n], "filingDate": ["2018-05-10"], "form": ["8-K"]}
    refs = [{"name": "old-1.json", "filingFrom": "2015-01-01", "filingTo": "2018-12-31"},
            {"name": "old-2.json", "filingFrom": "2019-01-01", "filingTo": None}]
    (tmp_path / "c1.json").write_text(json.dumps({"cik": "1", "filings": {"recent": page("new"), "files": refs}}))
    (tmp_path / "c2.json").write_text(json.dumps({"cik": "2", "filings": {"recent": page("two"), "files": refs[:1]}}))
    (tmp_path / "old-1.json").write_text(json.dumps(page("one")))
    (tmp_path / "old-2.json").write_text(json.dumps(page("later")))
    raw = filing_index.read_index_files(spark, str(tmp_path))
    def kept(year):
        pages, rejects = filing_index.company_pages(raw, year)
        assert rejects.count() == 0
        return sorted((r.cik, r.page.accessionNumber[0]) for r in pages.collect())
    assert kept(None) == [("1", "later"), ("1", "new"), ("1", "one"), ("2", "one"), ("2", "two")]
    assert kept(2016) == [("1", "new"), ("1", "one"), ("2", "one"), ("2", "two")]
    assert kept(2020) == [("1", "later"), ("1", "new"), ("2", "two")]


def test_tags_that_the_whole_tag_pattern_leaves_to_the_scan():
    grid = lambda page: [t["rows"] for t in page_grids(page)]
    assert grid("<table><tr><td a=b\"c>1</td x=\">\">2<td colspan = '2' it's>3</table>") == [[["1", "3", "3"]]]
    assert grid("<table><tr><td a=\"1>x<td>2</table>") == [[["x", "2"]]]
    assert grid("<table><tr><td/colspan=2>1<th><script>a < b</SCRIPT >2<!-- > --></table>") == [[["1", "1", "2"]]]
