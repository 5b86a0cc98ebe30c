"""E5: PDF files -> page texts -> document text (SRC-7, FLT-7, UD-6, AG-3, FLT-12).

``binaryFile`` lists and reads the files in parallel; the magic-number check
runs in the JVM; page extraction is a pluggable per-file function run with
``mapInPandas`` (no PDF library ships with this image, so one is injected);
pages are re-assembled in page order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from filingflow.functions.text import is_pdf
from filingflow.operators import concat, quality

PageExtractor = Callable[[bytes], "list[str]"]

PAGE_SCHEMA = StructType([StructField("path", StringType()), StructField("page_no", IntegerType()),
                          StructField("page_text", StringType()), StructField("error", StringType())])


def default_extractor() -> PageExtractor:
    """A PDF library when one is installed, else an error naming the gap."""
    try:
        from pypdf import PdfReader  # type: ignore
    except ImportError:  # pragma: no cover - depends on the image
        def missing(_b: bytes) -> list[str]:
            raise RuntimeError("no PDF text extractor installed; pass extractor=")
        return missing
    import io

    def extract(b: bytes) -> list[str]:
        return [p.extract_text() or "" for p in PdfReader(io.BytesIO(b)).pages]
    return extract


def read_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob) \
        .option("recursiveFileLookup", "true").load(path)


def checked(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """FLT-7: ``(pdfs, rejects)`` by the %PDF magic number."""
    tagged = quality.validate(files.select("path", "content"),
                              [("not a PDF (missing %PDF header)", is_pdf("content"))])
    good, bad = quality.split(tagged)
    return good, bad.select("path", "reject_reason")


def pages(pdfs: DataFrame, extractor: PageExtractor | None = None) -> DataFrame:
    """UD-6: one row per page ``(path, page_no, page_text, error)``; a file
    that fails to parse yields one row with the error and no text."""
    fn = extractor or default_extractor()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    for i, t in enumerate(fn(bytes(content))):
                        out.append((path, i, t, None))
                except Exception as e:  # noqa: BLE001
                    out.append((path, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "page_no", "page_text", "error"])

    return pdfs.select("path", "content").mapInPandas(run, PAGE_SCHEMA)


def document_text(page_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """AG-3 + FLT-12: ``(texts, errors)``; non-empty pages in order, each
    followed by a newline; a PDF with no text pages gives ``''``."""
    ok = page_rows.where(F.col("error").isNull())
    errors = page_rows.where(F.col("error").isNotNull()).select("path", F.col("error").alias("reject_reason"))
    return concat.page_concat(ok, ["path"], "page_no", "page_text"), errors


def extract(spark: SparkSession, path: str, extractor: PageExtractor | None = None
            ) -> tuple[DataFrame, DataFrame]:
    pdfs, rejects = checked(read_files(spark, path))
    texts, errors = document_text(pages(pdfs, extractor))
    return texts, rejects.unionByName(errors)
