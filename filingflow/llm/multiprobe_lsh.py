"""Nearest neighbours by multiprobe p-stable hashing.

Each of ``TABLES`` hash tables has k functions floor((a.x + b) / w) with
Gaussian a, so that near vectors agree by Euclidean distance.  A query visits
its own bucket and those reached by perturbing some functions by one, in the
order of estimated success: the least sum of squared distances to the bucket
borders that are crossed comes first.  The buckets' members are merged over
tables, and all of them are ranked by exact distance.

k grows with the logarithm of the number of vectors; w and the number of
probes are fitted on a bounded sample (``SAMPLE`` vectors, ``SAMPLE_QUERIES``
queries, against brute force) to a recall of ``RECALL``; where ``MAX_PROBES``
do not reach it, k is lowered until they do, and if none does, that is an error.
The index itself holds every vector, and no bucket is capped.

Equal vectors are one class, found by grouping; a class keeps its k + 1 least
ids, which are all that can be among k results.  Queries are dealt into blocks
of about ``BLOCK`` classes, and the members of the buckets that a block visits
are sent with their vectors once per block, in parts of about ``PART`` vectors.

Defined results: vectors that are null, zero, of another length than most, or
hold null or non-finite components take no part, nor do rows without an id; of
rows that share an id the least vector counts, once; ties go to the smaller id;
with fewer than k other rows all that are found are given; other columns are
dropped.  Recall is measured in tests/llm against brute force.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filingflow.llm.store import Scratch

TABLES = 20
RECALL, SAMPLE, SAMPLE_QUERIES, MAX_PROBES = 0.97, 4096, 64, 2048
#: Bucket width over the median distance of the k-th neighbour.
WIDTH = 2.35
BLOCK, PART = 512, 20_000
#: Queries whose probes one task lists: long work on few bytes.
PROBING = 64
_PAIRS = 1 << 16


class Hashes:
    def __init__(self, dimension: int, functions: int, width: float, tables: int = TABLES, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.functions, self.width, self.tables, self.probes = functions, width, tables, 0
        self.a = rng.normal(size=(dimension, tables * functions))
        self.b = rng.random(tables * functions) * min(width, 1e300)
        self.odd = rng.integers(1, 1 << 62, (tables, functions), np.int64) * 2 + 1

    def slots(self, x: np.ndarray) -> np.ndarray:
        """rows x tables x functions: position in bucket widths."""
        return ((x @ self.a + self.b) / self.width).reshape(len(x), self.tables, self.functions)

    def keys(self, slots: np.ndarray) -> np.ndarray:
        return (np.floor(slots).astype(np.int64) * self.odd).sum(2)

    def visits(self, slots: np.ndarray, probes: int) -> np.ndarray:
        """rows x tables x (1 + probes) bucket keys, likeliest first; the own bucket again where there are no more."""
        home = self.keys(slots)
        out = np.repeat(home[:, :, None], probes + 1, 2)
        down = slots - np.floor(slots)
        cost = np.concatenate([down, 1 - down], 2) ** 2
        step = np.concatenate([-self.odd, self.odd], 1)
        order = np.argsort(cost, 2, kind="stable")
        cost = np.take_along_axis(cost, order, 2)
        for r in range(len(slots)):
            for t in range(self.tables):
                shift = step[t, order[r, t]]
                function = (order[r, t] % self.functions).tolist()
                for i, chosen in enumerate(_perturbations(cost[r, t].tolist(), function, probes)):
                    out[r, t, i + 1:i + 2] += shift[list(chosen)].sum()
        return out


def _perturbations(cost: list[float], function: list[int], most: int):
    """Sets of perturbations by rising total cost, at most one per function."""
    heap, found, m = [(cost[0], (0,))], 0, len(cost)
    while heap and found < most:
        total, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if last + 1 < m:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*chosen, last + 1)))
        if len({function[i] for i in chosen}) == len(chosen):
            found += 1
            yield chosen


def fit(sample: np.ndarray, vectors: int, k: int) -> Hashes:
    """Width and number of probes for the recall wanted, by brute force on the sample."""
    if vectors <= k + 1:  # one bucket, as all are wanted
        return Hashes(sample.shape[1], 1, np.inf, 1)
    queries = sample[:SAMPLE_QUERIES]
    near = min(k, len(sample) - 1)  # at least 1
    d = ((queries ** 2).sum(1)[:, None] + (sample ** 2).sum(1) - 2 * queries @ sample.T)
    d[np.arange(len(queries)), np.arange(len(queries))] = np.inf
    true = np.argsort(d, 1, kind="stable")[:, :near]
    scale = float(np.sqrt(np.maximum(np.median(np.take_along_axis(d, true[:, -1:], 1)), 0)))
    functions = max(4, round(0.75 * math.log2(max(2, vectors))))
    # with fewer functions buckets are wider, so that fewer probes reach the recall
    for functions in range(functions, 0, -1):
        hashes = Hashes(sample.shape[1], functions, WIDTH * scale or 1.0)
        keys, slots = hashes.keys(hashes.slots(sample)), hashes.slots(queries)
        probes, most = 8, 0
        while most < MAX_PROBES:
            seen = hashes.visits(slots, probes)
            hit = np.array([np.any([np.isin(keys[row, t], seen_q[t]) for t in range(hashes.tables)], 0) for row, seen_q in zip(true, seen)])
            hashes.probes = most = probes
            if hit.mean() >= RECALL:
                return hashes
            probes = math.ceil(probes * 1.5)
    raise ValueError(f"no number of functions reaches a recall of {RECALL} on the sample with {MAX_PROBES} probes")


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def _emit(shipped, probing: bool, *carried: str):
    def run(batches):
        hashes = shipped.value
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                slots = hashes.slots(_matrix(batch.column("vec")))
                keys = hashes.visits(slots, hashes.probes).reshape(len(batch), -1) if probing else hashes.keys(slots)
                row = np.repeat(np.arange(len(batch)), keys.shape[1])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row)) for c in carried), pa.array(keys.ravel())], [*carried, "key"])
    return run


def _rerank(keep: int):
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        empty = pa.table({"q": pa.array([], pa.int64()), "cid": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not candidates.num_rows or not queries.num_rows:
            return empty
        lists = candidates.column("qs").combine_chunks()
        asked, counts = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
        ends = np.concatenate([[0], np.cumsum(counts)])
        v, cids = _matrix(candidates.column("vec").combine_chunks()), candidates.column("cid").to_numpy()
        qids, q = queries.column("cid").to_numpy(), _matrix(queries.column("vec").combine_chunks())
        numbers = queries.column("q").to_numpy()
        place = np.zeros(numbers.max() + 1, np.int64)
        place[numbers] = np.arange(len(numbers))
        # the best so far, by query, score and id; the score of each query's last when there are enough
        at, cid, score, last = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.full(len(qids), np.inf)
        i = 0
        while i < len(v):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + _PAIRS, "right")) - 1)
            row, to = np.repeat(np.arange(i, j), counts[i:j]), place[asked[ends[i]:ends[j]]]
            d = v[row] - q[to]
            d = np.sqrt((d * d).sum(1))
            near = d <= last[to]
            at, cid, score = np.concatenate([at, to[near]]), np.concatenate([cid, cids[row[near]]]), np.concatenate([score, d[near]])
            order = np.lexsort((cid, score, at))
            rank = np.arange(len(order)) - np.searchsorted(at[order], at[order])
            full = order[rank == keep - 1]
            last[at[full]] = score[full]
            order = order[rank < keep]
            at, cid, score, i = at[order], cid[order], score[order], j
        return pa.table({"q": pa.array(qids[at]), "cid": pa.array(cid), "score": pa.array(score)})
    return run


def _sample(classes: DataFrame, n: int) -> np.ndarray:
    """The vectors of the ``SAMPLE`` first of ``n`` classes by hash.

    Each task sends as many candidates as are wanted in all, so only hashes
    below twice the share wanted are asked for.
    """
    order = F.xxhash64("cid")
    below = classes.where(order <= -(1 << 63) + min((1 << 64) - 1, (1 << 65) * SAMPLE // max(1, n)))
    for some in (below, classes):  # all, if hashes are so uneven that too few are below
        rows = some.orderBy(order, "cid").limit(SAMPLE).select("vec").collect()
        if len(rows) >= min(SAMPLE, n):
            break
    return np.array([r.vec for r in rows], float)


def _join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """By shuffle and merge: a broadcast goes whole through the driver, and Spark
    takes a side's size from its files or, behind Python, from the rows read."""
    return left.join(right.hint("merge"), key, how)


def nearest(df: DataFrame, id_col: str, vec_col: str, is_query: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) of the nearest found to each row for which ``is_query`` (of the column ``id``) holds."""
    scratch = Scratch(df.sparkSession, "nearest")
    vec = F.col("vec")
    whole = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(vec, lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where(F.col("id").isNotNull() & F.coalesce(whole, F.lit(False)))
    size = rows.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), "size").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if size is None:
        return df.sparkSession.createDataFrame([], schema)
    rows = scratch.put(rows.where(F.size("vec") == size["size"]).groupBy("id").agg(F.min("vec").alias("vec")), "rows")
    # classes of equal vectors, with the least ids of each
    least = rows.withColumn("r", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("r") <= k + 1)
    classes = least.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))  # at most k + 1 a class
    classes = scratch.put(classes.select(F.col("ids")[0].alias("cid"), "vec", "ids"), "classes")
    asked = scratch.put(_join(rows.where(is_query), classes, "vec").select("id", "cid"), "asked")
    asked_classes = asked.select("cid").distinct()
    n, n_asking = classes.count(), asked_classes.count()
    blocks, parts = max(1, math.ceil(n_asking / BLOCK)), max(1, math.ceil(n / PART))
    # lists of queries hold their short numbers in the block
    block = F.pmod(F.xxhash64("cid", F.lit(1)), F.lit(blocks)).cast("int")
    number = F.row_number().over(Window.partitionBy("block").orderBy("cid")).cast("short")
    asking = scratch.put(_join(classes, asked_classes, "cid", "left_semi").select("cid", "vec", block.alias("block")).withColumn("q", number), "asking")
    hashes = fit(_sample(classes, n), n, k)
    shipped = df.sparkSession.sparkContext.broadcast(hashes)  # TABLES * k * dimension numbers
    index = classes.select("cid", "vec").mapInArrow(_emit(shipped, False, "cid"), "cid long, key long")
    probes = asking.repartition(max(1, math.ceil(n_asking / PROBING)), "cid").mapInArrow(_emit(shipped, True, "block", "q"), "block int, q short, key long").groupBy("key", "block").agg(F.collect_set("q").alias("qs"))
    hits = _join(index, probes, "key").groupBy("cid", "block").agg(F.array_distinct(F.flatten(F.collect_list("qs"))).alias("qs"))
    part = F.pmod(F.xxhash64("cid", F.lit(2)), F.lit(parts)).cast("int").alias("part")
    left = _join(hits, classes.select("cid", "vec"), "cid").select("block", part, "cid", "vec", "qs")
    right = asking.select("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "q", "cid", "vec")
    best = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(_rerank(k + 1), "q long, cid long, score double")
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("score", "cid"))).where(F.col("r") <= k + 1)
    best = _join(best, classes.select("cid", "ids"), "cid").select("q", "score", "ids")
    pairs = _join(best, asked.select(F.col("id").alias("query_id"), F.col("cid").alias("q")), "q").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    out = scratch.put(pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "out")
    scratch.drop("rows", "classes", "asked", "asking")
    return out


def op2_multiprobe_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest of every hundredth embedding, among all."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(rows, "vec_id", "embedding", F.col("id") % 100 == 0)
