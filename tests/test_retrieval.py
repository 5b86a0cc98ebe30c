"""In-filing retrieval (FIXTURES C6) and plan shape."""

import pytest
from pyspark.sql import functions as F

from filingflow.operators import retrieval

CHUNKS = [(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (1, 2, [0.6, 0.8]), (1, 3, [1.0, 0.0]), (2, 0, [0.3, 0.4])]
QUERIES = [[1.0, 0.0], [0.0, 1.0]]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "filing_id int, chunk_index int, embedding array<float>")


def ids(df, f):
    return [r["chunk_index"] for r in df.where(F.col("filing_id") == f).orderBy("merged_rank").collect()]


def test_per_query_topk(spark, chunks):
    scored = retrieval.score_all(chunks, QUERIES, "filing_id")
    top = retrieval.top_k_per_query(scored.drop("embedding"), "filing_id", "chunk_index", 2)
    got = {(r["filing_id"], r["query_no"]): [] for r in top.collect()}
    for r in top.orderBy("rank").collect():
        got[(r["filing_id"], r["query_no"])].append(r["chunk_index"])
    assert got[(1, 0)] == [0, 3] and got[(1, 1)] == [1, 2] and got[(2, 0)] == [0]


def test_first_seen_and_best_score(spark, chunks):
    fs = retrieval.retrieve(chunks, QUERIES, "filing_id", "chunk_index", k=2, merge="first_seen")
    bs = retrieval.retrieve(chunks, QUERIES, "filing_id", "chunk_index", k=2, merge="best_score")
    assert ids(fs, 1) == [0, 3] and ids(bs, 1) == [0, 1]
    assert ids(fs, 2) == [0] and ids(bs, 2) == [0]


def test_per_filing_queries_dataframe(spark, chunks):
    q = spark.createDataFrame([(1, 0, [0.0, 1.0]), (2, 0, [1.0, 0.0])], "filing_id int, query_no int, qv array<float>")
    bs = retrieval.retrieve(chunks, q, "filing_id", "chunk_index", k=2)
    assert ids(bs, 1) == [1, 2] and ids(bs, 2) == [0]


def test_cosine_metric(spark):
    df = spark.createDataFrame([(1, 0, [2.0, 0.0]), (1, 1, [0.0, 0.5])], "filing_id int, chunk_index int, embedding array<float>")
    r = retrieval.retrieve(df, [[0.0, 3.0]], "filing_id", "chunk_index", k=1, metric="cosine").first()
    assert r["chunk_index"] == 1 and abs(r["best_score"] - 1.0) < 1e-12


def test_topk_is_partially_limited_before_shuffle(spark, chunks):
    top = retrieval.retrieve(chunks, QUERIES, "filing_id", "chunk_index", k=2)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_blocks_equal_brute_force(spark, monkeypatch):
    """Many filings in many batches, a hot one, ties, null and short vectors, and more queries than a block holds."""
    import random
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    rng = random.Random(2)
    rows, queries = [], []
    for f in range(12):
        for c in range(400 if f == 0 else rng.randrange(30)):
            v = rng.choice([[rng.randrange(-3, 4) / 2 for _ in range(4)], [1.0, 0.0, 0.0, 0.5], None, [1.0], [0.0] * 4])
            rows.append((f if f else None if c % 50 == 0 else 0, c, v))
        queries += [(f, n, [rng.randrange(-2, 3) / 2 for _ in range(4)]) for n in range(rng.choice([1, 2, 7]))]
    df = spark.createDataFrame(rows, "filing_id int, chunk_index int, embedding array<float>").repartition(5)
    qs = spark.createDataFrame(queries, "filing_id int, query_no int, qv array<double>")

    def score(v, q, metric):
        if v is None or len(v) != len(q):
            return None
        s = sum(a * b for a, b in zip(v, q))
        size = (sum(a * a for a in v) * sum(b * b for b in q)) ** 0.5
        return s if metric == "ip" else round(s / size, 9) if size else None

    last = lambda s: (s is None, -(s or 0))
    for metric in ("ip", "cosine"):
        want, best = {}, {}
        for f, n, q in queries:
            scored = sorted(((score(v, q, metric), c) for g, c, v in rows if g == f), key=lambda x: (*last(x[0]), x[1]))
            want.update({(f, n, r): x for r, x in enumerate(scored[:5], 1)})
            for s, c in scored:
                best[f, c] = min(best.get((f, c), s), s, key=last)
        rounded = lambda s: None if s is None else round(s, 9)
        got = {(r.filing_id, r.query_no, r["rank"]): (rounded(r.score), r.chunk_index) for r in retrieval.top_k(df, qs, "filing_id", "chunk_index", 5, metric=metric).collect()}
        if metric == "ip":
            assert got == want
        assert {k: s for k, (s, _) in got.items()} == {k: s for k, (s, _) in want.items()}
        merged = retrieval.retrieve(df, qs, "filing_id", "chunk_index", k=4, metric=metric).collect()
        for f in range(12):
            mine = sorted((s for (g, _), s in best.items() if g == f), key=last)[:4]
            assert [rounded(r.best_score) for r in sorted(merged, key=lambda r: r.merged_rank) if r.filing_id == f] == mine


def test_scores_are_matrix_products(spark, chunks):
    q = spark.createDataFrame([(1, 0, [0.0, 1.0])], "filing_id int, query_no int, qv array<float>")
    for queries in (q, QUERIES):
        for merge in ("best_score", "first_seen"):
            plan = retrieval.retrieve(chunks, queries, "filing_id", "chunk_index", merge=merge)._jdf.queryExecution().executedPlan().toString()
            assert "zip_with" not in plan and "aggregate(" not in plan and "WindowGroupLimit" in plan
