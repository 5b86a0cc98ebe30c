"""Flagship slice: filing HTML -> text -> minimum length -> word windows -> counts.

One scan stage with no shuffle: the windows of a page are built inside its row
(``transform`` over the window starts), so the per-page counts need no
group-by.  The only Python is the Arrow-batched entity unescape.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingflow.functions.text import add_clean_text, word_tokens
from filingflow.operators.chunking import window_arrays
from filingflow.operators.parallel import by_setting
from filingflow.sources.tables import read_table

# Test pages are short; the 500-word floor (MIN_FILING_WORDS) applies to real filings.
FLAGSHIP_MIN_WORDS = 20


def page_chunk_counts(spark: SparkSession, base_dir: str,
                      min_words: int = FLAGSHIP_MIN_WORDS) -> DataFrame:
    pages = by_setting(read_table(spark, base_dir, "pages", "page_id", "html"), ["page_id"])
    tok = add_clean_text(pages, "html").select("page_id", word_tokens("text").alias("tokens"))
    kept = tok.where(F.size("tokens") >= min_words)
    wins = kept.select("page_id", F.size("tokens").cast("bigint").alias("n_words"),
                       window_arrays(F.col("tokens")).alias("w"))
    return wins.select(
        "page_id", "n_words",
        F.size("w").cast("bigint").alias("n_chunks"),
        F.aggregate("w", F.lit(0).cast("bigint"), lambda acc, x: acc + F.size(x)).alias("n_window_tokens"))
