"""Status logs and life cycles (SNK-9, ST-2, ST-3).

Statuses are appended to a log, never updated in place; the current status of
a key is the log row with the greatest sequence, computed with a map-side
combined ``max_by``.  Transition tables say which moves are legal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Job and question life cycles.
JOB_STATUSES = ("pending", "running", "done", "error")
JOB_TRANSITIONS = (("pending", "running"), ("running", "done"), ("running", "error"))
QUESTION_STATUSES = ("NEW", "PROCESSING", "DONE", "ERROR")
QUESTION_TRANSITIONS = (("NEW", "PROCESSING"), ("ERROR", "PROCESSING"),
                        ("PROCESSING", "DONE"), ("PROCESSING", "ERROR"))
QUESTION_PENDING = ("NEW", "ERROR")


def current_status(log: DataFrame, key_cols: list[str], order_cols: list[str],
                   value_cols: list[str]) -> DataFrame:
    """Latest log entry per key by ``order_cols`` (e.g. ``[ts, seq]``)."""
    best = F.max_by(F.struct(*value_cols), F.struct(*order_cols)).alias("_s")
    return log.groupBy(*key_cols).agg(best).select(*key_cols, "_s.*")


def illegal_transitions(log: DataFrame, key_cols: list[str], order_col: str,
                        status_col: str, transitions) -> DataFrame:
    """Log rows whose move from the previous status is not in ``transitions``.

    The first entry of a key must be the first status of the cycle.
    """
    from pyspark.sql import Window
    w = Window.partitionBy(*key_cols).orderBy(order_col)
    prev = F.lag(status_col).over(w)
    allowed = F.array(*[F.struct(F.lit(a).alias("f"), F.lit(b).alias("t")) for a, b in transitions])
    first = transitions[0][0]
    with_prev = log.withColumn("_prev", prev)
    ok = F.when(F.col("_prev").isNull(), F.col(status_col) == first).otherwise(
        F.array_contains(allowed, F.struct(F.col("_prev").alias("f"), F.col(status_col).alias("t"))))
    return with_prev.where(~ok)
