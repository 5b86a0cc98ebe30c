"""Ranking operators: top-n per group, first match, explicit-ids-or-top-n,
oldest pending (WN-1, WN-2, JN-6, SL-2..SL-4).

Top-n uses ``row_number() <= n`` so Catalyst inserts ``WindowGroupLimit``
both before the shuffle (partial) and after it: a hot group sends at most n
rows per input partition across the network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n_per_group(df: DataFrame, group_cols: list[str], order: list[Column], n: int,
                    rank_col: str = "rank") -> DataFrame:
    """Rows ranked 1..n per group by ``order`` (which must be a total order)."""
    if n < 1:
        raise ValueError("n must be >= 1")
    w = Window.partitionBy(*group_cols).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)


def first_per_group(df: DataFrame, group_cols: list[str], order: list[Column]) -> DataFrame:
    """WN-2: the first row per group in ``order`` (e.g. feed position)."""
    return top_n_per_group(df, group_cols, order, 1, "_rn").drop("_rn")


def explicit_ids_or_top_n(requests: DataFrame, candidates: DataFrame, explicit: DataFrame,
                          request_key: list[str], item_key: str, order: list[Column],
                          n_col: str = "n") -> DataFrame:
    """JN-6: per request, the explicitly listed item ids when any are given,
    otherwise the request's top ``n`` candidates.

    ``requests``   request_key + n_col
    ``candidates`` request_key + item_key + ordering columns
    ``explicit``   request_key + item_key (requested ids)
    Returns request_key + item_key + ``source`` ('explicit' | 'top_n').
    """
    chosen = explicit.select(*request_key, item_key).dropDuplicates([*request_key, item_key]) \
        .withColumn("source", F.lit("explicit"))
    no_ids = requests.join(explicit.select(*request_key), request_key, "left_anti")
    top = top_n_varying(candidates, no_ids.select(*request_key, n_col), request_key, order, n_col)
    return chosen.unionByName(top.select(*request_key, item_key).withColumn("source", F.lit("top_n")))


def top_n_varying(candidates: DataFrame, requests: DataFrame, key_cols: list[str],
                  order: list[Column], n_col: str = "n", rank_col: str = "rank", first_of: str | None = None) -> DataFrame:
    """Top ``n`` candidates per key where ``n`` comes from each request row; with ``first_of``,
    by which ``order`` must begin, only those that have the least value of their key.

    The largest requested n (one number from the small request table) is a
    static bound, so the ranking gets a partial ``WindowGroupLimit`` before
    its shuffle -- a key holding a third of all candidates ships at most
    max(n) rows per input partition; each request then keeps ``rank <= n``.
    """
    max_n = requests.agg(F.max(n_col)).first()[0]
    if max_n is None:  # no requests at all
        return candidates.join(requests, key_cols).withColumn(rank_col, F.lit(None).cast("int")) \
            .where(F.lit(False))
    ranked = top_n_per_group(candidates, key_cols, order, int(max_n), rank_col)
    if first_of:  # the best candidate has it
        least = F.min(first_of).over(Window.partitionBy(*key_cols))
        ranked = ranked.withColumn("_least", least).where(F.col(first_of) == F.col("_least")).drop("_least")
    return ranked.join(requests, key_cols).where(F.col(rank_col) <= F.col(n_col))


def oldest(df: DataFrame, order: list[Column], n: int = 1) -> DataFrame:
    """SL-2: the n oldest rows (``TakeOrderedAndProject``, no global sort)."""
    return df.orderBy(*order).limit(n)
