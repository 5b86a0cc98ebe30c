"""Intermediate tables in the folder that the cluster shares.

A written table cuts lineage and outlives lost executors: later steps read the
files again instead of recomputing.  The folder is ``spark.checkpoint.dir``;
only a plain local session (tests) that has none gets a scratch folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="llm-scratch-"))
        d = sc.getCheckpointDir()
    return d.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Written tables of one operator call, and their deletion."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, {}

    def put(self, df: DataFrame, label: str) -> DataFrame:
        """Write ``df`` once and return the table read back with its schema."""
        path = f"{shared_dir(self.spark)}/{self.name}-{label}-{uuid.uuid4().hex[:12]}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[label] = path
        return back

    def drop(self, *labels: str) -> None:
        """Delete tables that no later step reads (none given: all)."""
        for label in labels or list(self.paths):
            _delete(self.spark, self.paths.pop(label))
