"""Stored tables dealt by key bucket (SNK-2, SNK-5, SNK-6, SNK-10, JN-2, ST-6).

A table is a Parquet folder partitioned by ``_bucket``, a hash of its key.  A
batch touches the buckets of its keys only: reads for it name those buckets as
partition filters, and a merge rewrites them by dynamic partition overwrite, so
the work grows with the batch and its buckets, not with the table.

A merge first writes the new content of the touched buckets beside the table,
in a folder named by the batch, and then copies it over.  A batch that is run
again finds that folder complete and copies it again, so a run that was lost
while it replaced a bucket loses no rows.  Folders of batches before the last
are deleted by the next merge.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filingflow.operators import merge

BUCKET = "_bucket"


class BucketedTable:
    """``schema`` is a DDL string or StructType of the rows without the bucket."""

    def __init__(self, spark: SparkSession, path: str, key_cols: list[str], schema, buckets: int = 64):
        self.spark, self.path, self.key_cols, self.buckets = spark, path.rstrip("/"), key_cols, buckets
        self.empty = spark.createDataFrame([], schema)
        self.columns = self.empty.columns

    def bucket(self) -> Column:
        # as text, so that an int and a bigint key meet; a null key has a bucket as well
        return F.pmod(F.xxhash64(*(F.col(c).cast("string") for c in self.key_cols)), F.lit(self.buckets)).cast("int")

    def _stored(self) -> DataFrame:
        with_bucket = self.empty.withColumn(BUCKET, F.lit(0))
        try:
            return self.spark.read.schema(with_bucket.schema).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return with_bucket

    def read(self) -> DataFrame:
        return self._stored().drop(BUCKET)

    def touched(self, batch: DataFrame) -> list[int]:
        """Buckets of the batch's keys; at most ``buckets`` numbers come to the driver."""
        return sorted(r[0] for r in batch.select(self.bucket().alias(BUCKET)).distinct().collect())

    def read_for(self, batch: DataFrame) -> DataFrame:
        """The rows of the batch's buckets: all that can share a key with it."""
        return self._stored().where(F.col(BUCKET).isin(self.touched(batch))).drop(BUCKET)

    def _complete(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _forget(self, batch_id) -> None:
        top = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}-merges")
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if fs.exists(top):
            for f in fs.listStatus(top):
                if f.getPath().getName() != f"batch_id={batch_id}":
                    fs.delete(f.getPath(), True)

    def merge(self, batch: DataFrame, batch_id: int | str, rule: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Put ``rule(rows of the touched buckets, batch)`` in place of those buckets.

        ``rule`` returns rows of keys that are in either; a bucket that it
        leaves empty is emptied.
        """
        merged = f"{self.path}-merges/batch_id={batch_id}"
        if not self._complete(merged):
            buckets = self.touched(batch)
            rows = rule(self._stored().where(F.col(BUCKET).isin(buckets)).drop(BUCKET), batch).select(*self.columns)
            # one row without values for each bucket, so that an emptied one is overwritten as well
            marks = self.spark.createDataFrame([(b,) for b in buckets], f"{BUCKET} int").withColumn("_mark", F.lit(True))
            rows = rows.withColumn(BUCKET, self.bucket()).withColumn("_mark", F.lit(False))
            rows.unionByName(marks, allowMissingColumns=True).write.mode("overwrite").parquet(merged)
        ready = self.spark.read.parquet(merged)
        fresh = ready.where("not _mark").drop("_mark")
        # few files per bucket; a bucket with a hot key is split over tasks
        fresh.hint("rebalance", BUCKET).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(BUCKET).parquet(self.path)
        emptied = ready.groupBy(BUCKET).agg(F.min("_mark").alias("empty")).where("empty").collect()  # at most ``buckets``
        for r in emptied:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{BUCKET}={r[0]}")
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        self._forget(batch_id)

    def replace(self, batch: DataFrame, batch_id: int | str) -> None:
        """SNK-6: all rows of the batch's keys are replaced by the batch's rows."""
        self.merge(batch, batch_id, lambda old, new: merge.replace_by_key(old, new, self.key_cols))

    def delete(self, keys: DataFrame, batch_id: int | str) -> None:
        """SNK-10: rows of the given keys go."""
        self.merge(keys, batch_id, lambda old, gone: merge.delete_keys(old, gone, self.key_cols))

    def insert(self, batch: DataFrame, batch_id: int | str, order_cols: list[str]) -> None:
        """SNK-4: rows whose key is stored already are left out; of several in the batch the first stays."""
        self.merge(batch, batch_id, lambda old, new: merge.insert_ignore(old, new, self.key_cols, order_cols)[0])

    def new(self, candidates: DataFrame) -> DataFrame:
        """JN-2: candidates whose key is not stored; only their buckets are read."""
        return merge.skip_done(candidates, self.read_for(candidates), self.key_cols)
