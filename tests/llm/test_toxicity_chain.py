import numpy as np

from filingflow.llm import toxicity_chain as tox


def accuracy(rows, labels):
    toxic = [(r.toxic, labels[r.doc_id]) for r in rows if r.doc_id in labels]
    caught = [t for t, y in toxic if y == 1]
    clean = [not t for t, y in toxic if y == 0]
    return np.mean(caught), np.mean(clean)


def test_query_on_all_documents(spark):
    sf = "/root/testdata/sf0.1"
    rows = tox.op6_toxicity_chain(spark, sf).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    caught, clean = accuracy(rows, labels)
    assert caught > 0.97 and clean > 0.99
    assert all(r.p_severe <= 1 and r.p_bad_quality >= 0 for r in rows) and any(r.p_severe > 0.5 for r in rows)


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    chain = tox.train(docs, labels.where("doc_id % 3 > 0"), "doc_id", "text", ["toxic"])
    rows = tox.score(docs.where("doc_id % 3 = 0"), chain, "text").selectExpr("doc_id", "p_toxic >= 0.5 as toxic").collect()
    caught, clean = accuracy(rows, {r.doc_id: r.toxic for r in labels.where("doc_id % 3 = 0").collect()})
    # about one in twenty of these labels is on a text without any toxic word
    assert caught > 0.85 and clean > 0.99


def test_later_categories_use_out_of_fold_log_odds():
    rng = np.random.default_rng(2)
    x = rng.random((400, 5)) < 0.5
    first = x[:, 0].astype(float)
    y = np.column_stack([first, first])
    row, column = np.nonzero(x)
    weights = tox.train_chain(row, column, y, 5, np.arange(400) % tox.FOLDS)
    assert [len(w) for w in weights] == [6, 7] and weights[1][5] > 0.1
    chain = tox.Chain(["a", "b"], np.append(np.arange(5), np.full((1 << tox.BITS) - 5, 5)), weights)
    odds = chain.log_odds(column, row, 400)
    assert ((odds > 0) == (y > 0)).all()


def test_edge_rows(spark):
    docs = spark.createDataFrame([(None, None, "a"), (1, "", "a"), (2, "!!! ...", "a"), (3, "good words", "a"), (4, "bad words", "a"), (4, "bad words", "a"), (5, "x" * 100_000, "a")] + [(i, "good " + "bad " * (i % 2), "a") for i in range(10, 40)], "doc_id long, text string, p_toxic string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10, 40)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    chain = tox.train(docs, labels, "doc_id", "text", ["toxic"])
    got = tox.score(docs, chain, "text").collect()
    by = {(r.doc_id, r.text): r.p_toxic for r in got}
    assert len(got) == docs.count() and by[None, None] == by[1, ""] == by[2, "!!! ..."] == 0
    assert by[4, "bad words"] > 0.5 > by[3, "good words"]
    none = tox.train(docs, labels.limit(0), "doc_id", "text", ["toxic"], severe_of="toxic")
    assert max(r.p_toxic for r in tox.score(docs, none, "text").collect()) < 1e-6
    ones = tox.train(docs, labels.where("toxic = 1"), "doc_id", "text", ["toxic"])
    assert min(r.p_toxic for r in tox.score(docs.where("doc_id >= 10"), ones, "text").collect()) > 0.99
    assert tox.score(docs.limit(0), chain, "text").count() == 0
