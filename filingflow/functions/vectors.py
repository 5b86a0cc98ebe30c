"""Vector scores on ``array<float>`` / ``array<double>`` columns (SC-14).

Higher-order functions keep the arithmetic in the JVM; every product is done
in double precision and summed left to right.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from filingflow.functions.common import as_col as _col


def dot(a, b) -> Column:
    """Inner product (the SQL "negative inner product" distance is its negation)."""
    prods = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda s, v: s + v)


def neg_inner_product(a, b) -> Column:
    return -dot(a, b)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """Cosine similarity; null when either vector has zero length."""
    den = norm(a) * norm(b)
    return F.when(den > 0, dot(a, b) / den)


def score(a, b, metric: str = "ip") -> Column:
    if metric == "ip":
        return dot(a, b)
    if metric == "cosine":
        return cosine(a, b)
    raise ValueError(f"unknown metric {metric!r}")
