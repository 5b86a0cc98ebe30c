"""Text functions over filing HTML and plain text (SC-6..SC-13, FLT-5..FLT-7).

Everything here is a JVM Column expression (regex functions are code-generated;
the array lambdas are interpreted but stay in the JVM), except markup and entity
removal and the Windows-1252 fallback, which are Arrow-batched pandas UDFs
applied to one narrow column.
"""

from __future__ import annotations

import html as _html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pyspark.sql.types import StringType

from filingflow.functions.common import as_col as _col
from filingflow.functions.html import series_outside_markup

# Fixed patterns.  Java regex syntax; (?U) makes \s, \S and \b Unicode-aware so
# the no-break spaces filings use count as whitespace.
WS_RUN_RE = r"(?U)\s+"
WORD_RE = r"(?U)\S+"
ITEM_507_RE = r"(?iU)\bITEM\s*5\.07\b"
STYLE_ATTR_RE = r"""(?i)(<[^>]*?)\sstyle\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)"""

# The named entities decoded natively in "common" mode
# (amp must be last so "&amp;lt;" is decoded exactly once, as one parser pass).
COMMON_ENTITIES = (
    ("&nbsp;", " "),
    ("&copy;", "©"),
    ("&reg;", "®"),
    ("&middot;", "·"),
    ("&ndash;", "–"),
    ("&mdash;", "—"),
    ("&lsquo;", "‘"),
    ("&rsquo;", "’"),
    ("&ldquo;", "“"),
    ("&rdquo;", "”"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&apos;", "'"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&amp;", "&"),
)


def _unescape_twice(s: pd.Series) -> pd.Series:
    def one(x):
        if "&" not in x:
            return x
        return _html.unescape(_html.unescape(x))
    return s.map(one, na_action="ignore")


# HTML entity unescape applied twice (parser pass + explicit pass, SC-10).
# Marked non-deterministic only so Catalyst evaluates it once instead of
# inlining it into every downstream filter / projection that reads it.
unescape_twice = F.pandas_udf(_unescape_twice, StringType()).asNondeterministic()


@F.pandas_udf(StringType())
def decode_cp1252(b: pd.Series) -> pd.Series:
    """Windows-1252 decode with replacement characters (SC-9 fallback)."""
    return b.map(lambda x: None if x is None else bytes(x).decode("windows-1252", errors="replace"))


strip_markup = F.pandas_udf(series_outside_markup, StringType()).asNondeterministic()

# markup and entities in one Python call
plain_text = F.pandas_udf(lambda pages: _unescape_twice(series_outside_markup(pages)), StringType()).asNondeterministic()


def collapse_whitespace(c) -> Column:
    """SC-11: every whitespace run -> one space, then trim."""
    return F.trim(F.regexp_replace(_col(c), WS_RUN_RE, " "))


def unescape_common(c) -> Column:
    """Native decoding of the fixed COMMON_ENTITIES list, one pass."""
    out = _col(c)
    for ent, ch in COMMON_ENTITIES:
        out = F.replace(out, F.lit(ent), F.lit(ch))
    return out


def html_to_text(c, unescape: str = "exact") -> Column:
    """SC-6: filing HTML -> clean text.  Also used where a simpler text-node
    join (SC-7) would do, so every path sees the same text.

    ``unescape="exact"`` decodes every HTML5 entity twice (parity with a
    parser pass followed by an explicit unescape); ``"common"`` decodes the
    fixed COMMON_ENTITIES list in the JVM.
    """
    if unescape == "exact":
        decoded = plain_text(_col(c))
    elif unescape == "common":
        decoded = unescape_common(unescape_common(strip_markup(_col(c))))
    elif unescape == "none":
        decoded = strip_markup(_col(c))
    else:
        raise ValueError(f"unknown unescape mode {unescape!r}")
    return collapse_whitespace(decoded)


def add_clean_text(df, html_col: str, out_col: str = "text"):
    """SC-6 as a DataFrame step: markup and entities go in one Arrow-batched
    Python call per row, whitespace is collapsed in the JVM."""
    return df.withColumn(out_col, html_to_text(html_col))


def word_count(c) -> Column:
    """SC-12: number of whitespace-separated words."""
    return F.regexp_count(_col(c), F.lit(WORD_RE))


def word_tokens(c) -> Column:
    """SC-13: whitespace word tokens (empty strings removed)."""
    return F.filter(F.split(_col(c), WS_RUN_RE), lambda x: x != "")


def detokenize(tokens) -> Column:
    return F.array_join(_col(tokens), " ")


def has_min_words(c, n: int = 500) -> Column:
    """FLT-6: non-empty and at least ``n`` words (null -> false)."""
    return F.coalesce(word_count(c) >= F.lit(n), F.lit(False))


def mentions_item_507(c) -> Column:
    """FLT-5: "Item 5.07" at word boundaries, any case, any Unicode space."""
    return F.coalesce(_col(c).rlike(ITEM_507_RE), F.lit(False))


def strip_style_attributes(c) -> Column:
    """SC-8: drop style="..." attributes from tags; text content untouched."""
    return F.regexp_replace(_col(c), STYLE_ATTR_RE, "$1")


def decode_bytes(c) -> Column:
    """SC-9: strict UTF-8 when valid, else Windows-1252 with replacement."""
    b = _col(c)
    as_str = b.cast("string")
    valid = F.is_valid_utf8(as_str)
    # a Python UDF in a conditional branch still runs for every row, so it is
    # fed the bytes only where the strict decode failed (null elsewhere)
    fallback = decode_cp1252(F.when(~valid, b))
    return F.when(b.isNull(), F.lit(None).cast("string")).when(valid, as_str).otherwise(fallback)


PDF_MAGIC = bytearray(b"%PDF")


def is_pdf(c) -> Column:
    """FLT-7: bytes start with %PDF (null / short -> false)."""
    return F.coalesce(F.substring(_col(c), 1, 4) == F.lit(PDF_MAGIC), F.lit(False))


def non_empty(c) -> Column:
    """FLT-12 / falsy test: not null and not the empty string."""
    return F.coalesce(F.length(_col(c)) > 0, F.lit(False))
