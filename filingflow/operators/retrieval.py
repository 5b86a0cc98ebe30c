"""Exact vector retrieval inside each filing (JN-5, WN-3, WN-4, AG-8, SC-14).

Search is always *within* a filing: an equi-join on the filing key plus matrix
products, no index and no all-pairs product.

- The chunks of a filing in one Arrow batch are a block, a contiguous matrix of
  their vectors; a query block is a matrix of at most ``QUERY_BLOCK`` query
  vectors of one filing.  They meet by an equi-join on the filing, so a query
  vector is copied once per block, not once per chunk, and a filing with a
  third of all chunks is many blocks that Spark can deal out.
- A pair of blocks is one matrix product, and each score is computed once.  Only the k best of every
  query, or the k best chunks, leave the pair.
- Query vectors that all filings share are a matrix in the task (no join).
- top-k per (filing, query) is ``row_number() <= k``; Catalyst adds a partial
  ``WindowGroupLimit`` before the shuffle.

Scores are summed in double precision in an order that doesn't depend on a
chunk's place, so equal vectors tie.  A null vector, one of another length than
the query's, or (cosine) of length zero has a null score and ranks last.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filingflow.operators.ranking import top_n_per_group

# Retrieval depth.
RAG_TOP_K = 20
#: Query vectors of one filing that are multiplied together.
QUERY_BLOCK = 64


def _products(chunks: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """Scores, chunks x queries; NaN where there is none."""
    if chunks.shape[1] != queries.shape[1]:
        return np.full((len(chunks), len(queries)), np.nan)
    out = np.einsum("ij,kj->ik", chunks, queries)
    if metric == "cosine":
        size = np.sqrt(np.einsum("ij,ij->i", chunks, chunks))[:, None] * np.sqrt(np.einsum("ij,ij->i", queries, queries))
        out = np.divide(out, size, out=np.full(out.shape, np.nan), where=size > 0)
    elif metric != "ip":
        raise ValueError(f"unknown metric {metric!r}")
    return out


def _matrices(vectors: pa.Array):
    """(row numbers, matrix) for every vector length of a list column; null vectors have length 0."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    size = vectors.value_lengths().fill_null(0).to_numpy()
    values = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    first = np.cumsum(size) - size
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        at = slice(first[rows[0]], first[rows[-1]] + d) if len(rows) == len(size) else (first[rows][:, None] + np.arange(d)).ravel()
        yield rows, values[at].reshape(len(rows), d)


def score_all(chunks: DataFrame, queries: Sequence[Sequence[float]], filing_col: str, emb_col: str = "embedding",
              metric: str = "ip") -> DataFrame:
    """JN-5a: chunks with ``scores`` = array of (query_no, score), one per query
    vector of a fixed list shared by all filings; one product per Arrow batch."""
    q = np.array([list(map(float, v)) for v in queries], float).reshape(len(queries), -1)
    kind = T.ArrayType(T.DoubleType())

    @F.pandas_udf(kind)
    def products(vectors: pd.Series) -> pd.Series:
        out = np.full((len(vectors), len(q)), np.nan)
        for rows, m in _matrices(pa.array([None if v is None else np.asarray(v, float) for v in vectors], pa.list_(pa.float64()))):
            out[rows] = _products(m, q, metric)
        return pd.Series(list(np.where(np.isnan(out), None, out)) if np.isnan(out).any() else list(out))

    scores = F.transform(F.col("_products"), lambda s, i: F.struct(i.alias("query_no"), s.alias("score")))
    return chunks.withColumn("_products", products.asNondeterministic()(emb_col)).withColumn("scores", scores).drop("_products")


def _query_blocks(queries: DataFrame, filing_col: str) -> DataFrame:
    """(filing, numbers, vectors) of at most QUERY_BLOCK queries each; ``queries`` is (filing, query_no, qv)."""
    q = queries.select(F.col(filing_col).alias("_of"), F.col("query_no").cast("int").alias("n"), F.col("qv").cast("array<double>").alias("v"))
    block = q.groupBy("_of", F.floor(F.col("n") / QUERY_BLOCK).alias("b")).agg(F.array_sort(F.collect_list(F.struct("n", "v"))).alias("q"))
    return block.select("_of", F.col("q.n").alias("_numbers"), F.col("q.v").alias("_vectors"))


def _chunk_blocks(chunks: DataFrame, filing_col: str, chunk_col: str, emb_col: str) -> DataFrame:
    """(filing, chunks, length, matrix): the vectors of a filing's chunks in one batch, as doubles row by row."""
    kinds = chunks.schema
    schema = T.StructType([T.StructField(filing_col, kinds[filing_col].dataType), T.StructField("_chunks", T.ArrayType(kinds[chunk_col].dataType)),
                           T.StructField("_length", T.IntegerType()), T.StructField("_matrix", T.BinaryType())])

    def run(batches):
        for batch in batches:
            filing = pa.compute.dictionary_encode(batch.column(0), null_encoding="encode").indices.to_numpy()
            out = []
            for rows, m in _matrices(batch.column(2)):
                order = np.argsort(filing[rows], kind="stable")
                code = filing[rows][order]
                for part in np.split(order, np.flatnonzero(code[1:] != code[:-1]) + 1):
                    out.append((rows[part], m.shape[1], m[part].tobytes()))
            first = pa.array([r[0] for r, _, _ in out], pa.int64())
            cuts = pa.array(np.cumsum([0] + [len(r) for r, _, _ in out]), pa.int32())
            every = pa.array(np.concatenate([r for r, _, _ in out]) if out else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(first), pa.ListArray.from_arrays(cuts, batch.column(1).take(every)), pa.array([d for _, d, _ in out], pa.int32()),
                                              pa.array([m for _, _, m in out], pa.binary())], [f.name for f in schema])

    return chunks.select(filing_col, chunk_col, emb_col).mapInArrow(run, schema)


def _ranked_products(chunks: DataFrame, queries: DataFrame, filing_col: str, chunk_col: str, emb_col: str, k: int, metric: str, best: bool) -> DataFrame:
    """(filing, query_no, chunk, score) of the k best of every query in each pair of blocks; with ``best``, the k best
    chunks by their best score there (query_no null)."""
    pairs = _chunk_blocks(chunks, filing_col, chunk_col, emb_col).join(_query_blocks(queries, filing_col), F.col(filing_col) == F.col("_of")).drop("_of")
    kinds = chunks.schema
    schema = T.StructType([T.StructField(filing_col, kinds[filing_col].dataType), T.StructField("query_no", T.IntegerType()),
                           T.StructField(chunk_col, kinds[chunk_col].dataType), T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                ids = batch.column("_chunks").slice(i, 1).flatten()
                m = np.frombuffer(batch.column("_matrix")[i].as_py(), float).reshape(len(ids), batch.column("_length")[i].as_py())
                numbers = batch.column("_numbers").slice(i, 1).flatten().to_numpy()
                score = np.full((len(ids), len(numbers)), np.nan)
                for at, q in _matrices(batch.column("_vectors").slice(i, 1).flatten()):
                    score[:, at] = _products(m, q, metric)
                if best:
                    score = np.fmax.reduce(score, 1, keepdims=True)
                place = np.empty(len(ids), np.int64)  # of each chunk in the order of chunks
                place[pa.compute.sort_indices(ids).to_numpy()] = np.arange(len(ids))
                order = np.lexsort((np.broadcast_to(place[:, None], score.shape), -score), axis=0)[:k]  # NaN is last
                column = np.broadcast_to(np.arange(score.shape[1]), order.shape)
                row, column = order.T.ravel(), column.T.ravel()
                value = score[row, column]
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(filing_col)[i], len(row)), pa.array(numbers[column], pa.int32(), mask=np.full(len(row), best)), ids.take(pa.array(row)),
                                                  pa.array(value, mask=np.isnan(value))], [f.name for f in schema])

    return pairs.mapInArrow(run, schema)


def top_k(chunks: DataFrame, queries: DataFrame | Sequence[Sequence[float]], filing_col: str, chunk_col: str,
          k: int = RAG_TOP_K, emb_col: str = "embedding", metric: str = "ip") -> DataFrame:
    """``(filing, query_no, chunk, score, rank)``: the k best chunks of every
    query in its filing.  ``queries`` is a fixed list of vectors shared by all
    filings (JN-5a) or a DataFrame ``(filing_col, query_no, qv)`` (JN-5b)."""
    if not isinstance(queries, DataFrame):
        return top_k_per_query(score_all(chunks.select(filing_col, chunk_col, emb_col), queries, filing_col, emb_col, metric), filing_col, chunk_col, k)
    found = _ranked_products(chunks, queries, filing_col, chunk_col, emb_col, k, metric, False)
    return top_n_per_group(found, [filing_col, "query_no"], [F.desc("score"), F.asc(chunk_col)], k, "rank")


def top_k_per_query(scored: DataFrame, filing_col: str, chunk_col: str,
                    k: int = RAG_TOP_K) -> DataFrame:
    """WN-3: ``(filing, query_no, chunk, score, rank)`` for the k best chunks
    of every (filing, query); ties broken by chunk position."""
    ex = scored.select(filing_col, chunk_col, F.inline("scores"))
    return top_n_per_group(ex, [filing_col, "query_no"],
                           [F.desc("score"), F.asc(chunk_col)], k, "rank")


def merge_first_seen(top: DataFrame, filing_col: str, chunk_col: str,
                     k: int = RAG_TOP_K) -> DataFrame:
    """WN-4 / AG-8 parity merge: walk the queries in order and each query's
    list in rank order, keep unseen chunks, stop at k."""
    first = top.groupBy(filing_col, chunk_col).agg(
        F.min(F.struct("query_no", "rank")).alias("_first"))
    return top_n_per_group(first, [filing_col], [F.asc("_first")], k, "merged_rank").drop("_first")


def merge_best_score(scored: DataFrame, filing_col: str, chunk_col: str,
                     k: int = RAG_TOP_K) -> DataFrame:
    """WN-4 useful default: rank chunks by their best score over all queries."""
    best = scored.withColumn("best_score", F.array_max(F.transform("scores", lambda s: s["score"])))
    return top_n_per_group(best.drop("scores"), [filing_col],
                           [F.desc("best_score"), F.asc(chunk_col)], k, "merged_rank")


def retrieve(chunks: DataFrame, queries, filing_col: str, chunk_col: str,
             emb_col: str = "embedding", k: int = RAG_TOP_K, merge: str = "best_score",
             metric: str = "ip") -> DataFrame:
    """Multi-query retrieval: ``(filing, chunk, merged_rank)`` plus the score."""
    if merge == "first_seen":
        return merge_first_seen(top_k(chunks, queries, filing_col, chunk_col, k, emb_col, metric), filing_col, chunk_col, k)
    if merge != "best_score":
        raise ValueError(f"unknown merge {merge!r}")
    if not isinstance(queries, DataFrame):
        scored = score_all(chunks.select(filing_col, chunk_col, emb_col), queries, filing_col, emb_col, metric)
        return merge_best_score(scored.drop(emb_col), filing_col, chunk_col, k)
    found = _ranked_products(chunks, queries, filing_col, chunk_col, emb_col, k, metric, True)
    # a chunk has a row for each query block it met
    best = found.groupBy(filing_col, chunk_col).agg(F.max("score").alias("best_score"))
    return top_n_per_group(best, [filing_col], [F.desc("best_score"), F.asc(chunk_col)], k, "merged_rank")


def first_rows_as_queries(chunks: DataFrame, filing_col: str, chunk_col: str,
                          emb_col: str = "embedding", n: int = 5) -> DataFrame:
    """Per-filing query set from the filing's own first ``n`` chunks
    ``(filing, query_no, qv)`` -- e.g. cover-page passages as queries."""
    # filter on the raw row_number so Catalyst plans a partial WindowGroupLimit
    w = Window.partitionBy(filing_col).orderBy(chunk_col)
    return (chunks.withColumn("_rn", F.row_number().over(w))
            .where(F.col("_rn") <= n)
            .select(filing_col, (F.col("_rn") - 1).alias("query_no"), F.col(emb_col).alias("qv")))
