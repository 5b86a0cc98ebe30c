"""Parquet table reads (SRC-9).

Tables are read lazily with an explicit column list so Catalyst prunes the
scan (``ReadSchema``) and pushes filters (``PushedFilters``) into parquet.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table_path(base_dir: str, name: str) -> str:
    return os.path.join(base_dir, f"{name}.parquet")


def read_table(spark: SparkSession, base_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(table_path(base_dir, name))
    return df.select(*columns) if columns else df
