"""Latest row per group (AG-1, SL-1).

Both modes are plain aggregations, so Spark combines them map-side before the
shuffle: a hot key (one company holding a third of all filings) is reduced in
every input partition first and only one partial row per partition travels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _q(c: str) -> str:
    return f"`{c}`"


def _with_keys(df: DataFrame, key_cols: list[str]) -> DataFrame:
    """Rows whose key columns are all present (grouping drops null keys)."""
    cond = F.lit(True)
    for k in key_cols:
        cond = cond & F.col(k).isNotNull()
    return df.where(cond)


def latest_nonnull(df: DataFrame, key_cols: list[str], order_col: str,
                   value_cols: list[str]) -> DataFrame:
    """Parity mode: per key and per column, the value from the row with the
    greatest ``order_col`` among rows where that column is not null.

    This is what "sort descending, then take the first non-null value of every
    column" returns, so one output row may mix values of different input rows.
    Rows with a null key are dropped.
    """
    kept = _with_keys(df, key_cols)
    aggs = [F.expr(f"max_by({_q(c)}, {_q(order_col)}) FILTER (WHERE {_q(c)} IS NOT NULL)").alias(c)
            for c in value_cols]
    return kept.groupBy(*key_cols).agg(*aggs)


def latest_whole_row(df: DataFrame, key_cols: list[str], order_cols: list[str],
                     value_cols: list[str]) -> DataFrame:
    """Strict mode: the one whole row with the greatest ``order_cols`` tuple."""
    kept = _with_keys(df, key_cols)
    best = F.max_by(F.struct(*value_cols), F.struct(*order_cols)).alias("_best")
    return kept.groupBy(*key_cols).agg(best).select(*key_cols, "_best.*")
