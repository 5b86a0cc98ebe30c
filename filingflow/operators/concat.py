"""Ordered string concatenation per group (AG-2, AG-3, AG-4, AG-9).

``collect_list`` is a partial (map-side) aggregate; the final array is sorted by
the explicit order key, so the result does not depend on shuffle order.  Use it
on groups whose size is bounded by the feature: top-k retrieved chunks (AG-2),
the pages of one document (AG-3), one rule page (AG-9).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingflow.functions.text import non_empty


def ordered_join(order_cols: list[str], text_col: str, sep: str) -> Column:
    """Aggregate expression: texts sorted by ``order_cols`` joined by ``sep``."""
    parts = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order_cols],
                                                 F.col(text_col).alias("_t"))))
    return F.array_join(F.transform(parts, lambda s: s["_t"]), sep)


def context_concat(df: DataFrame, group_cols: list[str], order_cols: list[str],
                   text_col: str, sep: str = "\n\n", name: str = "context") -> DataFrame:
    """AG-2: ranked chunk texts joined by a blank line, plus the part count."""
    return df.groupBy(*group_cols).agg(ordered_join(order_cols, text_col, sep).alias(name),
                                       F.count(F.lit(1)).alias("n_parts"))


def page_concat(df: DataFrame, group_cols: list[str], page_col: str, text_col: str,
                name: str = "text", block_pages: int = 64) -> DataFrame:
    """AG-3 + FLT-12: non-empty page texts in page order, each followed by a newline.

    Documents whose pages are all empty produce ``''`` (one row per document
    key present in ``df``).  Two levels: pages are joined within blocks of
    ``block_pages`` consecutive pages (many small groups, spread over tasks),
    then the blocks of a document are joined in order, so a very long
    document's final merge handles one string per block, not per page.
    """
    kept = F.when(non_empty(text_col), F.col(text_col))
    parts = F.array_sort(F.collect_list(F.when(kept.isNotNull(), F.struct(
        F.col(page_col).alias("_p"), kept.alias("_t")))))
    block_text = F.array_join(F.transform(parts, lambda s: F.concat(s["_t"], F.lit("\n"))), "")
    blocks = df.groupBy(*group_cols, F.floor(F.col(page_col) / block_pages).alias("_block")) \
        .agg(block_text.alias("_bt"))
    doc = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_block", "_bt"))),
                                   lambda s: s["_bt"]), "")
    return blocks.groupBy(*group_cols).agg(doc.alias(name))


def collect_rows(df: DataFrame, group_cols: list[str], order_cols: list[str],
                 value_cols: list[str], name: str = "rows") -> DataFrame:
    """AG-4: one ordered array of structs per group (job result payloads)."""
    st = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_cols)],
                  F.struct(*value_cols).alias("_v"))
    arr = F.transform(F.array_sort(F.collect_list(st)), lambda s: s["_v"])
    return df.groupBy(*group_cols).agg(arr.alias(name))
