"""Validation and diagnostics (FLT-10, FLT-11, FLT-14, SC-17).

``validate`` tags each row with the first failed rule; ``split`` turns that
into ``(good, rejects)``.  Both sides read the same tagged plan, so persist it
when both are consumed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingflow.functions.common import as_col as _col


def present(c) -> Column:
    """Truthy: not null and not the empty string (FLT-11)."""
    col = _col(c)
    return F.coalesce(col.isNotNull() & (col.cast("string") != ""), F.lit(False))


def one_of(c, values) -> Column:
    """SC-17 enum check (null -> false)."""
    return F.coalesce(_col(c).isin(*values), F.lit(False))


def within(c, lo, hi) -> Column:
    """SC-17 range check, inclusive (null -> false)."""
    return F.coalesce(_col(c).between(lo, hi), F.lit(False))


def validate(df: DataFrame, rules: list[tuple[str, Column]], reason_col: str = "reject_reason") -> DataFrame:
    """Add ``reason_col``: name of the first rule whose condition is not true, else null."""
    reason = None
    for name, ok in rules:
        cond = ~F.coalesce(ok, F.lit(False))
        reason = F.when(cond, F.lit(name)) if reason is None else reason.when(cond, F.lit(name))
    return df.withColumn(reason_col, reason if reason is not None else F.lit(None).cast("string"))


def split(tagged: DataFrame, reason_col: str = "reject_reason") -> tuple[DataFrame, DataFrame]:
    good = tagged.where(F.col(reason_col).isNull()).drop(reason_col)
    bad = tagged.where(F.col(reason_col).isNotNull())
    return good, bad


def diagnostics(requests: DataFrame, results: DataFrame, key_cols: list[str],
                reason: str | Column) -> DataFrame:
    """FLT-14: requests with no result rows, with a reason."""
    r = reason if isinstance(reason, Column) else F.lit(reason)
    return requests.join(results.select(*key_cols), key_cols, "left_anti") \
        .withColumn("reason", r)
