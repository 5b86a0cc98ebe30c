"""Form and item predicates, form classifier (FLT-2..FLT-4, PRJ-6, SC-3)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from filingflow.functions.common import as_col as _col

# Form patterns.
FORM_8K_PATTERN = "8-K"
PROXY_FORM_RE = r"(?i)^DEFR? ?14A$"
VOTE_ITEM = "5.07"

# Form code (upper case, spaces removed) -> (document class, revision).
FORM_CLASSES = (
    (("DEF14A",), "proxy_statement", "original"),
    (("DEFR14A",), "proxy_statement", "revision"),
    (("DEFA14A",), "proxy_supplement", "supplement"),
    (("DEFC14A", "PREC14A", "PRRN14A"), "contestant_proxy", "original"),
)
OTHER_CLASS = ("other", "other")


def form_matches(c, pattern: str = FORM_8K_PATTERN) -> Column:
    """FLT-2: regex ``pattern`` found anywhere, case-insensitive; null -> false.

    ``8-K`` therefore also accepts ``8-K/A`` and ``8-K12B``.
    """
    return F.coalesce(_col(c).rlike(f"(?i){pattern}"), F.lit(False))


def is_proxy_statement(c) -> Column:
    """FLT-3: DEF 14A or DEFR14A, optional space, anchored (DEFA14A excluded)."""
    return F.coalesce(_col(c).rlike(PROXY_FORM_RE), F.lit(False))


def items_include(c, item: str = VOTE_ITEM) -> Column:
    """FLT-4: comma-separated item list contains ``item`` (substring); null -> false."""
    return F.coalesce(_col(c).contains(item), F.lit(False))


def normalized_form(c) -> Column:
    """SC-3: upper case, spaces removed."""
    return F.upper(F.replace(_col(c), F.lit(" "), F.lit("")))


def form_class(c) -> Column:
    """PRJ-6: ``struct<doc_class string, revision string>`` from the form type."""
    f = normalized_form(c)
    cls = None
    for codes, dclass, revision in FORM_CLASSES:
        cond = f.isin(*codes)
        cls = (F.when(cond, F.struct(F.lit(dclass).alias("doc_class"), F.lit(revision).alias("revision")))
               if cls is None else
               cls.when(cond, F.struct(F.lit(dclass).alias("doc_class"), F.lit(revision).alias("revision"))))
    return cls.otherwise(F.struct(F.lit(OTHER_CLASS[0]).alias("doc_class"),
                                  F.lit(OTHER_CLASS[1]).alias("revision")))
