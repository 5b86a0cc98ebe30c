"""Hard negatives by a multiway hyperplane tree with sibling distance ranges.

Scores are integer inner products.  For every anchor the best rows of its own
label are positives; its negatives are the best rows of other labels whose
score lies in a window set by each positive's score.

The tree is that of Brin's geometric near-neighbour access tree: a node has up
to ``WAYS`` split points, a row goes to the nearest (a cell of the hyperplanes
between them), and for every split point and every sibling subtree the least
and largest distance from the point to the subtree's rows are stored.  Split
points come from a bounded sample of ``SAMPLE`` rows (least mixed ids); every
row is dealt through the tree, and the ranges cover all rows.

With norms, a window of scores is an annulus around the anchor: at a squared
norm between a and b, scores from s to t mean squared distances from
|q|^2 + a - 2t to |q|^2 + b - 2s.  The ranges of a subtree give the ring of
distances that its rows can have from the anchor; if ring and annulus do not
meet, the subtree is eliminated.  While rows are found, the window's lower end
rises to the score of the last one needed; the sample gives a first such score.
What is left of a leaf is scored exactly, so results are exact whatever the
tree eliminates.

On the cluster: leaves are packed into parts of bounded size in tree order, and
a leaf with more rows than a part is dealt over several by its ids' hash, so
copies of one vector don't meet in one task.  An anchor is sent once to each
part that has leaves it can't eliminate.  A part's rows come first in its
sorted partition, then anchors stream past them in batches.

Defined results: rows with a null id, label or vector, or a null or non-finite
component, take no part; rows that share an id are one row, that of the least
label, then vector; vectors of different lengths are compared as if zeros
filled the shorter one; ties go to the smaller id; other columns are dropped.
Components beyond what long scores can hold raise an error.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filingflow.llm.store import Scratch

WAYS, LEVELS, LEAF_ROWS, SAMPLE = 8, 4, 256, 4096
#: A part has about n / PARTS rows, at least LEAST_PART and at most PART_VALUES components.
PARTS, LEAST_PART, PART_VALUES = 64, 4096, 1 << 22
#: Anchors, and products of a step, that a task holds at once.
_ANCHORS, _PRODUCTS = 512, 1 << 20


def _matrix(column: pa.Array, dims: int, dtype) -> np.ndarray:
    """Rows x dims of an array<long> column, shorter rows filled with zeros."""
    offs = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)[offs[0]:offs[-1]]
    size = np.diff(offs)
    if (size == dims).all():
        return values.reshape(len(column), dims).astype(dtype)
    out = np.zeros((len(column), dims), dtype)
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(values)) - np.repeat(offs[:-1] - offs[0], size)] = values
    return out


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.astype(float), b.astype(float)
    return np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T))


class Tree:
    """Split points, children (a leaf as -1 - number), and, once measured, ranges and squared norms by leaf."""

    def __init__(self, sample: np.ndarray, levels: int, ways: int = WAYS):
        self.points, self.children, self.leaves = [], [], 0
        self._grow(sample, levels, ways)

    def _grow(self, rows: np.ndarray, levels: int, ways: int) -> int:
        points = _apart(rows, ways) if levels and len(rows) else rows[:0]
        if len(points) < 2:
            self.leaves += 1
            return -self.leaves
        number = len(self.points)
        self.points.append(points)
        self.children.append([])
        nearest = _distances(rows, points).argmin(1)
        self.children[number] = [self._grow(rows[nearest == j], levels - 1, ways) for j in range(len(points))]
        return number

    def descend(self, rows: np.ndarray, visit=None) -> np.ndarray:
        """Leaf of every row; ``visit(node, distances, nearest)`` sees each step."""
        leaf = np.zeros(len(rows), np.int64)
        todo = [(0, np.arange(len(rows)))] if self.points else []
        while todo:
            node, at = todo.pop()
            distances = _distances(rows[at], self.points[node])
            nearest = distances.argmin(1)
            if visit:
                visit(node, distances, nearest)
            for j, child in enumerate(self.children[node]):
                inside = at[nearest == j]
                if child < 0:
                    leaf[inside] = -1 - child
                elif len(inside):
                    todo.append((child, inside))
        return leaf

    def slots(self) -> tuple[list[int], int]:
        """First range of each node (points x children, row by row), and their number; squared norms of leaves follow."""
        first, total = [], 0
        for p in self.points:
            first.append(total)
            total += len(p) ** 2
        return first, total

    def measured(self, least: np.ndarray, largest: np.ndarray) -> Tree:
        first, total = self.slots()
        self.ranges = [(least[a:a + len(p) ** 2].reshape(len(p), -1), largest[a:a + len(p) ** 2].reshape(len(p), -1)) for a, p in zip(first, self.points)]
        self.norms = least[total:], largest[total:]
        return self

    def rings(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest distance that rows of each leaf can have, anchors x leaves."""
        low, high = np.zeros((len(anchors), self.leaves)), np.full((len(anchors), self.leaves), np.inf)
        todo = [(0, np.zeros(len(anchors)), np.full(len(anchors), np.inf))] if self.points else []
        while todo:
            node, above_low, above_high = todo.pop()
            d = _distances(anchors, self.points[node])
            least, largest = self.ranges[node]
            for j, child in enumerate(self.children[node]):
                near = np.maximum(above_low, np.maximum(d - largest[:, j], least[:, j] - d).max(1))
                far = np.minimum(above_high, (d + largest[:, j]).min(1))
                if child < 0:
                    low[:, -1 - child], high[:, -1 - child] = near, far
                else:
                    todo.append((child, near, far))
        return low, high

    def open(self, anchors: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
        """Leaves that can hold rows of any of an anchor's windows, anchors x leaves."""
        return _meets(anchors, lows, highs, self.rings(anchors), self.norms)


def _meets(anchors, lows, highs, rings, norms) -> np.ndarray:
    """Whether the annulus of any window meets the ring, anchors x leaves."""
    low, high = rings
    least, largest = norms
    square = (anchors.astype(float) ** 2).sum(1)[:, None]
    slack = 1e-7 * (np.sqrt(square) + np.sqrt(np.maximum(largest, 0)))  # rounding of the distances
    out = np.zeros(low.shape, bool)
    for s, t in zip(lows.astype(float).T[:, :, None], highs.astype(float).T[:, :, None]):
        inner = np.sqrt(np.maximum(0, square + least - 2 * t))
        outer = square + largest - 2 * s
        out |= (s <= t) & (outer >= -1e-9 * (square + largest)) & (np.sqrt(np.maximum(0, outer)) + slack >= low) & (inner - slack <= high)
    return out & (largest >= least)  # an empty leaf has no norms


def _apart(rows: np.ndarray, ways: int) -> np.ndarray:
    """Up to ``ways`` split points: of 3 * ways rows, greedily the one farthest from those chosen."""
    some = rows[:3 * ways]
    chosen, nearest = [0], _distances(some, some[:1])[:, 0]
    while len(chosen) < ways and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, _distances(some, some[chosen[-1]:chosen[-1] + 1])[:, 0])
    if len(chosen) == 1 and len(rows) > len(some):  # equal rows come first: look at all
        other = np.flatnonzero((rows != rows[0]).any(1))[:3 * ways - 1]
        return _apart(rows[np.append(0, other)], ways) if len(other) else rows[:1]
    return some[chosen]


def _best(hits: list[tuple], k: int) -> tuple[np.ndarray, ...]:
    """The k best of each (anchor, window): highest score, then smallest id."""
    anchor, window, score, ids = (np.concatenate(x) for x in zip(*hits))
    order = np.lexsort((ids, -score, window, anchor))
    anchor, window, score, ids = anchor[order], window[order], score[order], ids[order]
    first = np.ones(len(anchor), bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1])
    rank = np.arange(len(anchor)) - np.maximum.accumulate(np.where(first, np.arange(len(anchor)), 0))
    keep = rank < k
    return anchor[keep], window[keep], score[keep], ids[keep]


class _Search:
    """Windows of a batch of anchors against blocks of rows, with rising lower ends."""

    def __init__(self, ids, labels, vectors, lows, highs, k: int, same: bool):
        self.ids, self.labels, self.vectors, self.lows, self.highs, self.k, self.same = ids, labels, vectors, lows.copy(), highs, k, same
        self.found, self.fresh = [], 0

    def scan(self, ids, labels, rows, who: np.ndarray) -> None:
        """Score rows against the anchors numbered ``who``."""
        step = max(1, _PRODUCTS // max(1, len(who)))
        for a in range(0, len(ids), step):
            score = rows[a:a + step] @ self.vectors[who].T
            fits = (labels[a:a + step, None] == self.labels[who]) == self.same
            if self.same:
                fits &= ids[a:a + step, None] != self.ids[who]
            for w in range(self.lows.shape[1]):
                r, q = np.nonzero(fits & (score >= self.lows[who, w]) & (score <= self.highs[who, w]))
                if len(r):
                    self.found.append((who[q], np.full(len(q), w), score[r, q], ids[a:a + step][r]))
                    self.fresh += len(r)
            if self.fresh > 1 << 14:
                self.raise_lows()

    def raise_lows(self) -> None:
        if not self.fresh:
            return
        best = _best(self.found, self.k)
        self.found, self.fresh = [best], 0
        anchor, window, score, _ = best
        full = np.flatnonzero((anchor[self.k - 1:] == anchor[:len(anchor) - self.k + 1]) & (window[self.k - 1:] == window[:len(anchor) - self.k + 1])) if len(anchor) >= self.k else np.empty(0, int)
        last = full + self.k - 1
        self.lows[anchor[last], window[last]] = np.maximum(self.lows[anchor[last], window[last]], score[last])

    def result(self):
        self.raise_lows()
        return self.found[0] if self.found else tuple(np.empty(0, np.int64) for _ in range(4))


def _windows(batch: pa.RecordBatch, dtype) -> tuple[np.ndarray, np.ndarray]:
    """lows and highs, anchors x windows; missing windows are empty ones (1, 0)."""
    out = []
    for name, empty in (("lows", 1), ("highs", 0)):
        lists = batch.column(name).to_pylist()
        wide = max(map(len, lists), default=0)
        out.append(np.array([x + [empty] * (wide - len(x)) for x in lists], dtype).reshape(len(lists), wide))
    return out[0], out[1]


class _Plan:
    """What every task needs: broadcast once; its size is bounded by SAMPLE, WAYS and LEVELS."""

    def __init__(self, dims, dtype, tree, sample, part, chunks):
        self.dims, self.dtype, self.tree, self.sample, self.part, self.chunks = dims, dtype, tree, sample, part, chunks


def _measure(rows: DataFrame, dims: int, dtype, tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least, largest, counts): ranges of all slots, then squared norms of leaves; rows by leaf."""
    first, total = tree.value.slots()

    def run(batches):
        t = tree.value
        least, largest, counts = np.full(total + t.leaves, np.inf), np.full(total + t.leaves, -np.inf), np.zeros(t.leaves, np.int64)

        def visit(node, distances, nearest):
            ways = distances.shape[1]
            for j in range(ways):
                inside = distances[nearest == j]
                if len(inside):
                    at = first[node] + j + ways * np.arange(ways)
                    least[at], largest[at] = np.minimum(least[at], inside.min(0)), np.maximum(largest[at], inside.max(0))

        for batch in batches:
            x = _matrix(batch.column("v"), dims, dtype)
            leaf = t.descend(x, visit)
            square = (x.astype(float) ** 2).sum(1)
            np.minimum.at(least, total + leaf, square)
            np.maximum.at(largest, total + leaf, square)
            counts += np.bincount(leaf, minlength=t.leaves)
        at = np.flatnonzero(largest >= least)
        count = np.zeros(total + t.leaves, np.int64)
        count[total:] = counts
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(least[at]), pa.array(largest[at]), pa.array(count[at])], ["slot", "least", "largest", "n"])

    parts = rows.select("v").mapInArrow(run, "slot long, least double, largest double, n long").groupBy("slot").agg(F.min("least"), F.max("largest"), F.sum("n")).collect()
    least, largest, counts = np.full(total + tree.value.leaves, np.inf), np.full(total + tree.value.leaves, -np.inf), np.zeros(total + tree.value.leaves, np.int64)
    for slot, a, b, n in parts:
        least[slot], largest[slot], counts[slot] = a, b, n
    return least, largest, counts[total:]


def _deal(rows: DataFrame, plan) -> DataFrame:
    """The rows with their leaf and part."""
    def run(batches):
        p = plan.value
        for batch in batches:
            leaf = p.tree.descend(_matrix(batch.column("v"), p.dims, p.dtype))
            part = p.part[leaf] + batch.column("mixed").to_numpy() % p.chunks[leaf]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(leaf), *(batch.column(c) for c in ("id", "label", "v"))], ["part", "leaf", "id", "label", "v"])

    return rows.withColumn("mixed", F.abs(F.xxhash64("id") % (1 << 40))).mapInArrow(run, "part long, leaf long, id long, label long, v array<long>")


def _visits(anchors: DataFrame, plan, k: int, same: bool) -> DataFrame:
    """Anchors (id, label, v, lows, highs), once for each part that they can't eliminate."""
    def run(batches):
        p = plan.value
        ids, labels, sample = p.sample
        for whole in batches:
            for a in range(0, len(whole), _ANCHORS):
                batch = whole.slice(a, _ANCHORS)
                q = _matrix(batch.column("v"), p.dims, p.dtype)
                lows, highs = _windows(batch, p.dtype)
                search = _Search(batch.column("id").to_numpy(), batch.column("label").to_numpy(), q, lows, highs, k, same)
                search.scan(ids, labels, sample, np.arange(len(batch)))
                search.raise_lows()
                row, leaf = np.nonzero(p.tree.open(q, search.lows, highs))
                size = p.chunks[leaf]
                part = np.repeat(p.part[leaf], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                pairs = np.unique(np.column_stack([np.repeat(row, size), part]), axis=0)
                wide = lows.shape[1]
                raised = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * wide, pa.int32()), pa.array(search.lows.astype(np.int64).ravel()))
                upper = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * wide, pa.int32()), pa.array(highs.astype(np.int64).ravel()))
                for b in range(0, len(pairs), 4096):
                    at = pa.array(pairs[b:b + 4096, 0])
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[b:b + 4096, 1]), *(batch.column(c).take(at) for c in ("id", "label", "v")), raised.take(at), upper.take(at)],
                                                     ["part", "id", "label", "v", "lows", "highs"])

    return anchors.mapInArrow(run, "part long, id long, label long, v array<long>, lows array<long>, highs array<long>")


def _search(dealt: DataFrame, visits: DataFrame, plan, k: int, same: bool) -> DataFrame:
    """(anchor_id, window, id, score): the k best rows of every window in each part."""
    def runs(batch):
        """Stretches of one part and kind."""
        key = batch.column("part").to_numpy() * 2 + batch.column("anchor").to_numpy(zero_copy_only=False).astype(int)
        cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if b > a:
                yield int(key[a]) >> 1, bool(key[a] & 1), batch.slice(a, b - a)

    def run(batches):
        p = plan.value
        current, blocks, table = None, [], None
        for batch in batches:
            for part, is_anchor, piece in runs(batch):
                if part != current:
                    current, blocks, table = part, [], None
                if not is_anchor:
                    blocks.append((piece.column("id").to_numpy(), piece.column("label").to_numpy(), piece.column("leaf").to_numpy(), _matrix(piece.column("v"), p.dims, p.dtype)))
                    continue
                if not blocks:
                    continue
                if table is None:
                    ids, labels, leaf, rows = (np.concatenate(x) for x in zip(*blocks))
                    order = np.argsort(leaf, kind="stable")
                    leaves, first = np.unique(leaf[order], return_index=True)
                    table = ids[order], labels[order], rows[order], leaves, np.append(first, len(order))
                    blocks = [()]
                for a in range(0, len(piece), _ANCHORS):
                    some = piece.slice(a, _ANCHORS)
                    anchor, window, score, found = _scan_part(some, table, p, k, same)
                    yield pa.RecordBatch.from_arrays([some.column("id").take(pa.array(anchor)), pa.array(window, pa.int32()), pa.array(found), pa.array(score.astype(np.int64))], ["anchor_id", "window", "id", "score"])

    nothing = F.array().cast("array<long>")
    rows = dealt.select("part", F.lit(False).alias("anchor"), "id", "label", "v", "leaf", nothing.alias("lows"), nothing.alias("highs"))
    both = rows.unionByName(visits.select("part", F.lit(True).alias("anchor"), "id", "label", "v", F.lit(0).cast("long").alias("leaf"), "lows", "highs"))
    return both.repartition("part").sortWithinPartitions("part", "anchor").mapInArrow(run, "anchor_id long, window int, id long, score long")


def _scan_part(some: pa.RecordBatch, table, p, k: int, same: bool):
    ids, labels, rows, leaves, first = table
    q = _matrix(some.column("v"), p.dims, p.dtype)
    lows, highs = _windows(some, p.dtype)
    search = _Search(some.column("id").to_numpy(), some.column("label").to_numpy(), q, lows, highs, k, same)
    low, high = p.tree.rings(q)
    for n in np.argsort(low[:, leaves].mean(0), kind="stable"):  # the nearest leaves first
        one = slice(leaves[n], leaves[n] + 1)
        who = np.flatnonzero(_meets(q, search.lows, highs, (low[:, one], high[:, one]), tuple(x[one] for x in p.tree.norms)))
        if len(who):
            search.scan(ids[first[n]:first[n + 1]], labels[first[n]:first[n + 1]], rows[first[n]:first[n + 1]], who)
            search.raise_lows()
    return search.result()


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(df: DataFrame, id_col: str, vector_col: str, label_col: str, anchors: Column, positives: int = 5, negatives: int = 10, least_percent: int = 30, most_percent: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vector_col`` holds integers (array<long>).  ``anchors`` is a condition on
    ``id``.  A negative's score lies between the two percentages of the
    positive's score.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "hard-negatives")
    valid = df.select(F.col(id_col).alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v")).where("id is not null and label is not null and v is not null and not exists(v, x -> x is null)")
    rows = scratch.put(valid.groupBy("id").agg(F.min(F.struct("label", "v")).alias("row")).select("id", "row.label", "row.v"), "rows")
    n, dims, most = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.greatest(F.abs(F.coalesce(F.array_max("v"), F.lit(0))), F.abs(F.coalesce(F.array_min("v"), F.lit(0)))))).first()
    dims, most = max(1, dims or 0), most or 0
    if dims * most * most >= 1 << 62:
        raise ValueError("scores of these vectors do not fit into a long")
    dtype = np.float64 if dims * most * most < 1 << 52 else np.int64  # either way exact
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow().combine_chunks().to_batches()
    sample = (sample[0]["id"].to_numpy(), sample[0]["label"].to_numpy(), _matrix(sample[0]["v"], dims, dtype)) if sample else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, dims), dtype))
    levels = min(LEVELS, math.ceil(math.log(max(1, n / LEAF_ROWS), WAYS)))
    tree = spark.sparkContext.broadcast(Tree(sample[2], levels))
    least, largest, counts = _measure(rows, dims, dtype, tree)
    size = max(1, min(PART_VALUES // dims, max(LEAST_PART, n // PARTS)))
    chunks = np.maximum(1, -(-counts // size))
    part, at, room = np.zeros(len(counts), np.int64), 0, 0
    for leaf, (rows_in, c) in enumerate(zip(counts.tolist(), chunks.tolist())):  # leaves of one part are neighbours in the tree
        if c > 1 or rows_in > room:
            at, room = at + 1, size
        part[leaf] = at
        at, room = (at + c, 0) if c > 1 else (at, room - rows_in)
    plan = spark.sparkContext.broadcast(_Plan(dims, dtype, tree.value.measured(least, largest), sample, part, chunks))
    dealt = scratch.put(_deal(rows, plan), "dealt")
    asking = rows.where(anchors)
    any_score = F.array(F.lit(-(1 << 62)).cast("long")), F.array(F.lit(1 << 62).cast("long"))
    first = _visits(asking.select("id", "label", "v", any_score[0].alias("lows"), any_score[1].alias("highs")), plan, positives, True)
    kin = scratch.put(_top(_search(dealt, first, plan, positives, True), positives).select("anchor_id", F.col("rank").alias("positive_rank"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    windows = kin.groupBy(F.col("anchor_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("positive_rank", "positive_score"))).alias("p"))
    ends = windows.select("id", F.expr(f"transform(p, x -> cast(ceil(cast(x.positive_score as decimal(30,0)) * {least_percent} / 100) as bigint))").alias("lows"),
                          F.expr(f"transform(p, x -> cast(floor(cast(x.positive_score as decimal(30,0)) * {most_percent} / 100) as bigint))").alias("highs"))
    second = _visits(asking.join(ends, "id").select("id", "label", "v", "lows", "highs"), plan, negatives, False)
    found = _top(_search(dealt, second, plan, negatives, False), negatives).withColumn("positive_rank", F.col("window") + 1)
    out = found.join(kin, ["anchor_id", "positive_rank"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    out = scratch.put(out, "out")
    scratch.drop("rows", "dealt", "positives")
    return out


def op13_gnat_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives of every hundredth vector by its positives' windows."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    finite = "embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = df.where(finite).select("vec_id", label.alias("label"), F.expr("transform(embedding, x -> floor(256 * cast(x as double)))").alias("v"))
    return hard_negatives(whole, "vec_id", "v", "label", F.col("id") % 100 == 0)


OP13_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM r AS a JOIN r AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT p.*, s.other AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other)::INTEGER AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
