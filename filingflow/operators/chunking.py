"""Overlapping token windows (WN-5, WN-6) and chunk counts (AG-5).

The windowing rule is ``for start in range(0, n, stride)``, stopping at the
first window that reaches the end.  The window starts are therefore
``0, stride, 2*stride, ...`` up to the largest multiple of ``stride`` that is
``<= n - overlap - 1`` (and a single window for any 0 < n <= size).  That is a
``sequence`` expression, so chunking is a narrow ``posexplode`` inside the
scan stage: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingflow.functions import spans
from filingflow.functions.text import detokenize, word_tokens

# Window size and overlap, in tokens.
CHUNK_SIZE = 800
CHUNK_OVERLAP = 200


def _check(size: int, overlap: int) -> int:
    if not (0 < overlap < size):
        raise ValueError("overlap must satisfy 0 < overlap < size")
    return size - overlap


def window_starts(n_tokens: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Array of 0-based window starts; empty when there are no tokens."""
    stride = _check(size, overlap)
    last = F.greatest(F.lit(0), n_tokens - F.lit(overlap + 1))
    return F.when(n_tokens > 0, F.sequence(F.lit(0), last, F.lit(stride))).otherwise(
        F.array().cast("array<int>"))


def chunk_count(n_tokens: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """AG-5 closed form: 0 for no tokens, else 1 + ceil(max(0, n - size) / stride)."""
    stride = _check(size, overlap)
    extra = F.greatest(F.lit(0), n_tokens - F.lit(size))
    return F.when(n_tokens > 0, F.lit(1) + F.ceil(extra / F.lit(stride)).cast("int")).otherwise(F.lit(0))


def window_arrays(tokens: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """All windows of one token array as ``array<array<string>>`` (row-local)."""
    return F.transform(window_starts(F.size(tokens), size, overlap),
                       lambda s: F.slice(tokens, s + 1, size))


def chunk_tokens(df: DataFrame, tokens_col: str, key_cols: list[str],
                 size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                 keep_tokens: bool = False) -> DataFrame:
    """Explode an ``array<string>`` token column into overlapping windows.

    Returns ``key_cols + [chunk_index int, chunk_start int, chunk_tokens array<string>]``.
    Any tokenizer can be used upstream; the windowing only needs the array.
    """
    n = F.size(tokens_col)
    starts = window_starts(n, size, overlap)
    out = df.select(*key_cols, F.col(tokens_col).alias("_tok"),
                    F.posexplode(starts).alias("chunk_index", "chunk_start"))
    out = out.withColumn("chunk_tokens", F.slice("_tok", F.col("chunk_start") + 1, size))
    cols = [*key_cols, "chunk_index", "chunk_start", "chunk_tokens"]
    return out.select(*cols, *(["_tok"] if keep_tokens else []))


def chunk_text(df: DataFrame, text_col: str, key_cols: list[str],
               size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Text -> word windows -> ``(keys, chunk_index, n_tokens, chunk_text)``."""
    tok = df.select(*key_cols, word_tokens(text_col).alias("_tokens"))
    ch = chunk_tokens(tok, "_tokens", key_cols, size, overlap)
    return ch.select(*key_cols, "chunk_index",
                     F.size("chunk_tokens").alias("n_tokens"),
                     detokenize("chunk_tokens").alias("chunk_text"))


SPAN_TYPE = ("array<struct<chunk_index:int,first_token:int,n_tokens:int,char_start:int,char_end:int,"
             "chunk_text:string>>")


def chunk_spans(df: DataFrame, text_col: str, key_cols: list[str],
                size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """The windows of ``chunk_text`` with their place in the text.

    ``key_cols, chunk_index, first_token, n_tokens, char_start, char_end,
    chunk_text``: offsets in code points, the text cut from the original, so
    its white space stays.  The text from one window's ``char_start`` to the
    next one's joins to the whole text (up to white space at either end).  One
    pass over a text, in time linear in it; null texts and texts without words
    give no rows.
    """
    _check(size, overlap)
    windows = F.pandas_udf(spans.series_spans(size, overlap), SPAN_TYPE)
    return df.select(*key_cols, F.inline(windows(text_col)))


def chunk_counts(df: DataFrame, text_col: str, key_cols: list[str],
                 size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """AG-5 without materialising chunks: one row per input row."""
    n = F.size(word_tokens(text_col))
    return df.select(*key_cols, chunk_count(n, size, overlap).alias("n_chunks"))


def count_per_key(df: DataFrame, key_cols: list[str], name: str = "n") -> DataFrame:
    """AG-5 over a materialised child table (chunks, embeddings, questions)."""
    return df.groupBy(*key_cols).agg(F.count(F.lit(1)).alias(name))
