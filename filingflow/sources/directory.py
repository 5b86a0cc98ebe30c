"""Company directory with positional rows (SRC-3, JN-1, SC-1).

``{"fields": [...], "data": [[cik, name, ticker, exchange], ...]}`` -> one row
per 10-digit CIK; for a duplicated CIK the last entry in file order wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from filingflow.functions.keys import pad_cik

DIRECTORY_SCHEMA = StructType([
    StructField("fields", ArrayType(StringType())),
    StructField("data", ArrayType(ArrayType(StringType()))),
])


def read_directory_files(spark: SparkSession, paths) -> DataFrame:
    return spark.read.schema(DIRECTORY_SCHEMA).option("multiLine", True).json(paths) \
        .withColumn("source_file", F.col("_metadata.file_path"))


def directory_rows(raw: DataFrame) -> DataFrame:
    """Positional arrays -> (cik, name, ticker, exchange), last entry wins.

    The order key is (source_file, position) so several directory files
    resolve deterministically.  The result has one row per company and is
    small; joins against it let AQE pick a broadcast from measured size.
    """
    ex = raw.select("source_file", F.posexplode("data").alias("pos", "r"))
    rows = ex.select(
        "source_file", "pos",
        pad_cik(F.get("r", 0)).alias("cik"),
        F.get("r", 1).alias("name"), F.get("r", 2).alias("ticker"), F.get("r", 3).alias("exchange"))
    return last_entry_per_cik(rows, "cik", ["source_file", "pos"], ["name", "ticker", "exchange"])


def last_entry_per_cik(rows: DataFrame, cik_col: str, order_cols: list[str],
                       value_cols: list[str]) -> DataFrame:
    """Deduplicate directory entries: the greatest ``order_cols`` wins.

    A map-side-combined aggregation: a CIK repeated millions of times costs
    one partial row per input partition.
    """
    best = F.max_by(F.struct(*value_cols), F.struct(*order_cols)).alias("_b")
    return rows.where(F.col(cik_col).isNotNull()).groupBy(cik_col).agg(best).select(cik_col, "_b.*")


def with_company(filings: DataFrame, directory: DataFrame, cik_col: str = "cik") -> DataFrame:
    """JN-1: left join on the padded CIK; unknown companies keep null metadata."""
    d = directory.withColumnRenamed("cik", "_dir_cik")
    return filings.join(d, pad_cik(F.col(cik_col)) == F.col("_dir_cik"), "left").drop("_dir_cik")
