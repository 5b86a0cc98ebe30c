"""Stage hand-off files (SRC-8, SNK-2, SNK-3).

Per-filing JSON objects can pass between stages (a text file, a JSON list of
chunks, a JSON list of embeddings).  Here stages hand over
DataFrames; these helpers read and write the per-filing JSON layout when an
outside producer or consumer needs it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StringType, StructField, StructType

from filingflow.operators.bucketed import BUCKET, BucketedTable

CHUNK_RECORD = StructType([StructField("chunk_index", IntegerType()), StructField("chunk_text", StringType()),
                           StructField("embedding", ArrayType(FloatType()))])


def read_chunk_files(spark: SparkSession, path: str, key_from_path: str = r"/([^/]+)/[^/]*$") -> DataFrame:
    """SRC-8: files holding one JSON array per filing -> chunk rows.

    Accepts arrays of records (``chunk_index, chunk_text, embedding``) and
    plain arrays of strings (chunk texts, index = position).  The filing key
    is taken from the file path (by default the parent folder name).
    """
    raw = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    recs = F.from_json("value", ArrayType(CHUNK_RECORD))
    texts = F.from_json("value", ArrayType(StringType()))
    parsed = raw.select(F.regexp_extract("file", key_from_path, 1).alias("filing_key"),
                        recs.alias("recs"), texts.alias("texts"))
    as_recs = parsed.where(F.exists("recs", lambda r: r["chunk_text"].isNotNull())) \
        .select("filing_key", F.inline("recs"))
    as_texts = parsed.where(~F.coalesce(F.exists("recs", lambda r: r["chunk_text"].isNotNull()), F.lit(False))) \
        .select("filing_key", F.posexplode("texts").alias("chunk_index", "chunk_text")) \
        .withColumn("embedding", F.lit(None).cast(ArrayType(FloatType())))
    return as_recs.unionByName(as_texts)


def write_artifacts(texts: DataFrame, path: str, key_cols: list[str], partition_col: str | None = None,
                    batch_id: int | str | None = None, buckets: int = 64) -> None:
    """SNK-2: HTML / text artefacts, replaced filing by filing: only filings of
    this batch change, those stored before stay.  ``partition_col`` is an
    ordinary column of the stored rows.  A batch that is run again under the
    same ``batch_id`` leaves the same table."""
    if partition_col and partition_col not in texts.columns:
        raise ValueError(f"no column {partition_col}")
    BucketedTable(texts.sparkSession, path, key_cols, texts.schema, buckets).replace(texts, batch_id if batch_id is not None else uuid.uuid4().hex)


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """All stored artefacts."""
    return spark.read.parquet(path).drop(BUCKET)


def chunks_as_json(chunks: DataFrame, key_col: str, with_embedding: bool = True) -> DataFrame:
    """SNK-3: one JSON array per filing, in chunk order (export layout).

    Groups are single filings, bounded by the filing's size.
    """
    fields = [F.col("chunk_index").cast("int").alias("chunk_index"), "chunk_text"]
    if with_embedding:
        fields.append("embedding")
    arr = F.array_sort(F.collect_list(F.struct(*fields)))
    return chunks.groupBy(key_col).agg(F.to_json(arr).alias("json"))
