import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from filingflow.llm import multiprobe_lsh as lsh


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        out[int(ids[q])] = sorted((float(d[j]), int(ids[j])) for j in range(len(ids)) if j != q)[:k]
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_query_recall(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()
    rows = [r for r in rows if r.embedding and all(c is not None and math.isfinite(c) for c in r.embedding) and any(r.embedding)]
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    want = brute(ids, x, np.flatnonzero(ids % 100 == 0), 10)
    got = {}
    for r in lsh.op2_multiprobe_lsh(spark, f"/root/testdata/{sf}").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    found = 0
    for q, ranked in want.items():
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 11))
        assert [(s, v) for _, v, s in mine] == sorted((s, v) for _, v, s in mine)
        for _, v, s in mine:
            assert s == pytest.approx(np.sqrt(((x[ids == v][0] - x[ids == q][0]) ** 2).sum()), rel=1e-12)
        found += len({v for _, v, _ in mine} & {v for _, v in ranked})
    assert found / sum(map(len, want.values())) >= 0.9


def test_edge_rows(spark):
    rng = random.Random(1)
    good = [(i, [float(rng.randrange(5)) for _ in range(3)] if i % 3 else [1.0, 2.0, 3.0]) for i in range(1, 61)]
    bad = [(100, None), (200, [0.0, 0.0, 0.0]), (300, [1.0, None, 2.0]), (400, [float("nan"), 1.0, 1.0]), (500, [float("inf"), 1.0, 1.0]), (600, [1.0]), (None, [1.0, 1.0, 1.0])]
    rows = [r for r in good if any(r[1])] + bad + [good[4]]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    got = lsh.nearest(df, "vec_id", "embedding", F.col("id") % 10 == 0, 4).collect()
    valid = [r for r in good if any(r[1])]
    ids, x = np.array([i for i, _ in valid]), np.array([v for _, v in valid])
    want = brute(ids, x, np.flatnonzero(ids % 10 == 0), 4)
    mine = {}
    for r in got:
        mine.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    assert set(mine) == set(want)
    copies = {q for q in want if q % 3 == 0}
    for q in copies:  # own copies come first, smaller ids first
        assert [(s, v) for _, s, v in sorted(mine[q])] == want[q]


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank) for r in lsh.nearest(df, "vec_id", "embedding", F.col("id") == 0).collect()] == [(0, 1)]
    assert lsh.nearest(df.limit(0), "vec_id", "embedding", F.col("id") == 0).count() == 0
    assert lsh.nearest(df.limit(1), "vec_id", "embedding", F.lit(True)).count() == 0


def test_perturbations_are_ordered_and_whole():
    rng = random.Random(2)
    for _ in range(20):
        f = rng.randrange(1, 6)
        down = [rng.random() for _ in range(f)]
        pairs = sorted([(d * d, i) for i, d in enumerate(down)] + [((1 - d) ** 2, i) for i, d in enumerate(down)])
        cost, function = [c for c, _ in pairs], [i for _, i in pairs]
        sets = list(lsh._perturbations(cost, function, 10**6))
        totals = [sum(cost[i] for i in s) for s in sets]
        assert totals == sorted(totals) and len(sets) == len(set(sets)) == 3 ** f - 1


def test_fit_lowers_the_functions_until_the_recall_holds(monkeypatch):
    sample = np.random.default_rng(6).normal(size=(600, 64))
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    monkeypatch.setattr(lsh, "MAX_PROBES", 40)
    hashes = lsh.fit(sample, 10**9, 10)
    d = ((sample[:64, None] - sample) ** 2).sum(2)
    true = np.argsort(d, 1, kind="stable")[:, 1:11]
    keys, seen = hashes.keys(hashes.slots(sample)), hashes.visits(hashes.slots(sample[:64]), hashes.probes)
    hit = [[any(keys[v, t] in seen[q, t] for t in range(hashes.tables)) for v in true[q]] for q in range(64)]
    assert np.mean(hit) >= lsh.RECALL
    monkeypatch.setattr(lsh, "RECALL", 1.1)
    with pytest.raises(ValueError):
        lsh.fit(sample, 100, 10)


def test_no_table_goes_through_the_driver(spark, monkeypatch):
    """Python's rows are estimated from those read: 300 rows look small enough for a broadcast, their 20 tables of probes need not be."""
    plans = []

    class Noted(lsh.Scratch):
        def put(self, df, label):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return super().put(df, label)

    monkeypatch.setattr(lsh, "Scratch", Noted)
    x = np.random.default_rng(8).normal(size=(300, 8))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = lsh.nearest(df, "vec_id", "embedding", F.col("id") % 3 == 0, 5)
    assert got.count() == 500
    assert "SortMergeJoin" in " ".join(plans) and "Broadcast" not in " ".join(plans)


def test_sample_is_the_first_by_hash_and_few_rows_are_sent(spark, monkeypatch):
    monkeypatch.setattr(lsh, "SAMPLE", 40)
    n = 4000
    classes = spark.range(n).select(F.col("id").alias("cid"), F.array(F.col("id").cast("float")).alias("vec"))
    want = [[float(r.cid)] for r in classes.orderBy(F.xxhash64("cid"), "cid").limit(40).collect()]
    sent = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            sent.add(batch.num_rows)
            yield batch

    frame, order = type(classes), type(classes).orderBy
    monkeypatch.setattr(frame, "orderBy", lambda self, *by: order(self.mapInArrow(counted, self.schema), *by))
    assert lsh._sample(classes, n).tolist() == want
    assert 40 <= sent.value <= 200
    assert len(lsh._sample(classes.limit(10), 10)) == 10
    # fewer below the bound than wanted: all are asked
    assert lsh._sample(classes, 10**9).tolist() == want


def test_fit_keeps_no_python_object_for_each_key(monkeypatch):
    sample = np.random.default_rng(9).normal(size=(200, 8))
    visits = lsh.Hashes.visits

    def late(self, slots, probes):  # nothing is found before 1,500 probes, as in a large table
        if probes >= 1500:
            return np.concatenate([visits(self, slots, 60), np.arange(probes - 60) + np.zeros((len(slots), self.tables, 1), np.int64)], 2)
        return np.arange(probes + 1) + np.zeros((len(slots), self.tables, 1), np.int64)

    monkeypatch.setattr(lsh.Hashes, "visits", late)
    monkeypatch.setattr(lsh, "RECALL", 0.5)
    tracemalloc.start()
    hashes = lsh.fit(sample, 10**4, 10)
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert hashes.probes >= 1500 and most < 100


def test_rerank_by_slices_is_exact(monkeypatch):
    monkeypatch.setattr(lsh, "_PAIRS", 7)
    rng = np.random.default_rng(10)
    v, q = rng.integers(0, 3, (40, 2)).astype(float), rng.integers(0, 3, (5, 2)).astype(float)  # many ties
    cids, qids, numbers = rng.permutation(40) + 100, np.array([50, 40, 30, 20, 10]), [3, 1, 2, 5, 4]
    lists = [sorted(rng.choice(numbers, rng.integers(0, 6), replace=False).tolist()) for _ in v]
    candidates = pa.table({"cid": cids, "vec": v.tolist(), "qs": pa.array(lists, pa.list_(pa.int16()))})
    queries = pa.table({"q": pa.array(numbers, pa.int16()), "cid": qids, "vec": q.tolist()})
    got = lsh._rerank(4)(candidates, queries).to_pylist()
    for i, number in enumerate(numbers):
        want = sorted((float(np.sqrt(((v[j] - q[i]) ** 2).sum())), int(cids[j])) for j in range(40) if number in lists[j])[:4]
        assert [(r["score"], r["cid"]) for r in got if r["q"] == qids[i]] == want
    assert lsh._rerank(4)(candidates.slice(0, 0), queries).num_rows == 0
