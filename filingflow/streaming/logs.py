"""Append-only logs written by micro-batches, with compaction.

Layout under a base folder:

- ``<base>/log/batch_id=<b>/``      rows appended by micro-batch ``b``
- ``<base>/snapshot/upto=<s>/``     the latest row per key over batches <= s

``read`` returns the newest snapshot plus only the log folders after it
(``batch_id > s`` prunes partitions), so the work per micro-batch stays
proportional to the recent log, not to the whole history.  ``compact`` writes
a new snapshot folder and never rewrites one that readers may be using.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingflow.operators import status

LOG, SNAPSHOT = "log", "snapshot"


def log_path(base: str, batch_id: int) -> str:
    return os.path.join(base, LOG, f"batch_id={batch_id}")


def _load(spark: SparkSession, path: str, schema: str | None) -> DataFrame | None:
    """The table, or None if nothing has been written there; other errors are raised."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _latest_snapshot(spark: SparkSession, base: str, before: int | None) -> int | None:
    found = _load(spark, os.path.join(base, SNAPSHOT), None)
    if found is None:
        return None
    v = (found if before is None else found.where(F.col("upto") < before)).agg(F.max("upto")).first()[0]
    return None if v is None else int(v)


def read(spark: SparkSession, base: str, schema: str | None, before: int | None = None) -> DataFrame | None:
    """All rows needed to know the current state: snapshot + newer log rows.

    With ``before``, the state that batch ``before`` started from: only rows
    and snapshots of earlier batches.  A batch that is run again must not see
    what it wrote itself the first time.
    ``schema`` is a DDL string that includes ``batch_id bigint``; with None the
    parquet footers give it (files this module wrote), and None is returned
    while nothing has been written.
    """
    log = _load(spark, os.path.join(base, LOG), schema)
    if log is None:
        if schema is None:
            return None
        log = spark.createDataFrame([], schema)
    if before is not None:
        log = log.where(F.col("batch_id") < before)
    s = _latest_snapshot(spark, base, before)
    if s is None:
        return log
    path = os.path.join(base, SNAPSHOT, f"upto={s}")
    snap = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    return snap.unionByName(log.where(F.col("batch_id") > s))


def compact(spark: SparkSession, base: str, schema: str, key_cols: list[str], order_cols: list[str]) -> int | None:
    """Write a snapshot of the latest row per key; returns its ``upto``."""
    rows = read(spark, base, schema)
    if rows is None:
        return None
    upto = rows.agg(F.max("batch_id")).first()[0]
    if upto is None:
        return None
    value_cols = [c for c in rows.columns if c not in key_cols]
    latest = status.current_status(rows, key_cols, order_cols, value_cols)
    latest.select(*rows.columns).write.mode("overwrite").parquet(
        os.path.join(base, SNAPSHOT, f"upto={int(upto)}"))
    return int(upto)

