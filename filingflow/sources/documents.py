"""Filing documents from files (SRC-6, SC-9).

``binaryFile`` lists and reads documents in parallel (one row per file, path
as the key); bytes are decoded as strict UTF-8 with a Windows-1252 fallback.
Fetching documents over the network is not part of this package: documents
arrive as files or as a table ``(url, html)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingflow.functions.text import decode_bytes


def read_html_files(spark: SparkSession, path: str, glob: str = "*.htm*") -> DataFrame:
    """``(path, length, html)`` for every matching file below ``path``."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob) \
        .option("recursiveFileLookup", "true").load(path)
    return raw.select("path", "length", decode_bytes("content").alias("html"))


def keyed_by_archive_path(docs: DataFrame, base: str) -> DataFrame:
    """Map stored files laid out as ``<base>/<cik>/<accession>/<document>``
    to the archive URL key used by the plans (``url``)."""
    from filingflow.functions.keys import ARCHIVE_BASE
    rel = F.regexp_replace("path", "^(file:)?" + base.rstrip("/") + "/", "")
    return docs.withColumn("url", F.concat_ws("/", F.lit(ARCHIVE_BASE), rel))
