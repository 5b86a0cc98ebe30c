"""Parallelism for CPU-heavy narrow stages, by an explicit setting.

Text cleaning, chunking and model calls cost far more CPU per byte than the
scan.  Large inputs have enough splits (``spark.sql.files.maxPartitionBytes``,
row groups).  For a few large single-row-group files a caller may set
``spark.filingflow.scanPartitions``; without it nothing is shuffled, whatever
the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

SETTING = "spark.filingflow.scanPartitions"


def by_setting(df: DataFrame, key_cols: list[str]) -> DataFrame:
    """``df`` dealt by its key into the partitions the session asks for, if it does."""
    n = df.sparkSession.conf.get(SETTING, None)
    # hash on the key: deterministic on task retry, unlike round-robin
    return df.repartition(int(n), *key_cols) if n else df
