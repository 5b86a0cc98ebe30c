import numpy as np
import pytest

from filingflow.llm import quality_bayes as qb
from filingflow.llm.logistic import fit_dense, fit_sparse

SF = "/root/testdata/sf0.01"


def test_query_agrees_with_labels(spark):
    got = {r.doc_id: r for r in qb.op7_quality_bayes(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == len(docs)
    right = [got[d.doc_id].keep == (labels[d.doc_id] == 1) for d in docs if d.doc_id in labels]
    assert np.mean(right) > 0.97
    assert all(0 <= r.quality_score <= 1 for r in got.values())


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = qb.train(docs, labels.where("doc_id % 3 > 0"), "doc_id", "text", "quality")
    out = qb.score(docs, model, "text", "source", "lang", carry_text=False).join(labels.where("doc_id % 3 = 0"), "doc_id").select("quality", "keep").collect()
    assert np.mean([r.keep == (r.quality == 1) for r in out]) > 0.98


def test_posteriors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{rng.integers(50)}" for _ in range(rng.integers(3, 40))) + ("!!!" * int(rng.integers(0, 9))), f"h{min(i % 7, 3)}", f"p{i % 2}") for i in range(120)]
    df = spark.createDataFrame(rows, "id long, text string, host string, path string")
    labels = spark.createDataFrame([(i, int("!" not in t)) for i, t, _, _ in rows[:60]], "id long, quality int")
    model = qb.train(df, labels, "id", "text", "quality")
    got = {r.id: r for r in qb.score(df, model, "text", "host", "path").collect()}
    p = {i: 1 / (1 + np.exp(-(got[i].evidence + model.base))) for i, *_ in rows}
    hosts = {h: [i for i, _, x, _ in rows if x == h] for _, _, h, _ in rows}
    paths = {(h, q): [i for i, _, x, y in rows if (x, y) == (h, q)] for _, _, h, q in rows}
    rate = np.mean(list(p.values()))

    def strength(groups, prior):
        n = np.array([len(g) for g in groups.values()])
        r = np.array([np.mean([p[i] for i in g]) for g in groups.values()])
        m = np.array([prior(k) for k in groups])
        free = len(n) - 1
        spread = ((n * (r - m) ** 2).sum() / (rate * (1 - rate)) - free) / (n.sum() - (n**2).sum() / n.sum() - free)
        return np.clip(1 / spread - 1, qb.LEAST, qb.MOST) if spread > 0 else qb.MOST

    kh = strength(hosts, lambda k: rate)
    host_rate = {h: (rate * kh + sum(p[i] for i in g)) / (kh + len(g)) for h, g in hosts.items()}
    kp = strength(paths, lambda k: host_rate[k[0]])
    for i, _, h, q in rows:
        host = (rate * kh + sum(p[j] for j in hosts[h]) - p[i]) / (kh + len(hosts[h]) - 1)
        site = np.clip((host * kp + sum(p[j] for j in paths[h, q]) - p[i]) / (kp + len(paths[h, q]) - 1), 1e-4, 1 - 1e-4)
        assert got[i].site_rate == pytest.approx(site, rel=1e-6)
        odds = np.clip(got[i].evidence + np.log(site / (1 - site)), -35, 35)
        assert got[i].quality_score == pytest.approx(1 / (1 + np.exp(-odds)), abs=1e-9)


def test_edge_rows(spark):
    rows = [(1, None, None, None, "k"), (1, "", "h", None, "k"), (None, "good words here", "h", "p", "k"), (2, " \n", "h", "p", "k"), (3, "x" * 200_000, "h", "p", "k"), (3, "x" * 200_000, "h", "p", "k")]
    df = spark.createDataFrame(rows, "id long, text string, host string, path string, keep string")
    model = qb.train(df, spark.createDataFrame([(3, 1), (None, 0)], "id long, quality int"), "id", "text", "quality")
    assert model is None
    got = qb.score(df, model, "text", "host", "path").collect()
    assert [r.keep for r in sorted(got, key=lambda r: (r.id or 0, r.text or ""))] == [True, False, False, False, True, True]
    assert qb.score(df.limit(0), None, "text", "host", "path").count() == 0


def test_fits_find_the_optimum():
    rng = np.random.default_rng(1)
    x = (rng.random((300, 6)) < 0.4).astype(float)
    y = (x @ [2, -1, 0, 1, 0, -2] + rng.normal(size=300) > 0).astype(float)
    dense = fit_dense(x, y)
    row, column = np.nonzero(x[:, :4])
    sparse = fit_sparse(row, column, x[:, 4:], y, 4, steps=300)
    assert np.allclose(dense, sparse, atol=0.02)
