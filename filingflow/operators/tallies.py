"""Vote tallies (AG-6).

total = for + against + abstentions + broker non-votes, null unless every kind
is reported (0 means a reported zero).  A stated total is kept when given and
flagged when it disagrees with the sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The tally kinds, in contract order.
TALLY_KINDS = ("for_votes", "against_votes", "abstentions", "broker_non_votes")


def kinds_sum(cols=TALLY_KINDS) -> Column:
    """Null-propagating sum of all kinds."""
    out = None
    for c in cols:
        out = F.col(c) if out is None else out + F.col(c)
    return out


def with_totals(df: DataFrame, stated_col: str = "total_votes", kinds=TALLY_KINDS) -> DataFrame:
    """Add ``computed_total``, fill ``stated_col`` when null, flag mismatches."""
    s = kinds_sum(kinds)
    return (df.withColumn("computed_total", s)
            .withColumn("total_mismatch", F.coalesce(F.col(stated_col) != s, F.lit(False)))
            .withColumn(stated_col, F.coalesce(F.col(stated_col), s)))
