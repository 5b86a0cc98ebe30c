"""Column-wise filing indexes (SRC-1, SRC-2, SO-1, AG-7, PRJ-1).

An index page stores one array per column (``{"form": [...], "filingDate":
[...]}``), either nested under ``filings.recent`` or at the top level (older
pages).  Pages are read with a declared schema, validated for equal column
lengths, and turned into rows with ``transform`` + ``inline`` -- a narrow,
per-row operation, so a million index files parallelise like any scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from filingflow.functions.keys import document_or_default, year_of_text

# Index columns carried (all strings on the wire).
INDEX_COLUMNS = ("accessionNumber", "filingDate", "reportDate", "form", "items",
                 "primaryDocument", "meetingDate")

PAGE_SCHEMA = StructType([StructField(c, ArrayType(StringType())) for c in INDEX_COLUMNS])
FILE_REF_SCHEMA = StructType([StructField("name", StringType()), StructField("filingCount", StringType()),
                              StructField("filingFrom", StringType()), StructField("filingTo", StringType())])
INDEX_FILE_SCHEMA = StructType([
    StructField("cik", StringType()),
    StructField("name", StringType()),
    StructField("filings", StructType([
        StructField("recent", PAGE_SCHEMA),
        StructField("files", ArrayType(FILE_REF_SCHEMA)),
    ])),
    # older pages carry the columns at the top level
    *PAGE_SCHEMA.fields,
])


def read_index_files(spark: SparkSession, paths, schema: StructType = INDEX_FILE_SCHEMA) -> DataFrame:
    """One row per JSON file, with ``source_file``; never infers a schema."""
    return (spark.read.schema(schema).option("multiLine", True).json(paths)
            .withColumn("source_file", F.col("_metadata.file_path")))


def page_struct(df: DataFrame) -> Column:
    """Shape 1 (``filings.recent``) when present, else shape 2 (top level)."""
    top = F.struct(*[F.col(c).alias(c) for c in INDEX_COLUMNS])
    return F.coalesce(F.col("filings.recent"), top)


def _present_sizes(page: Column, columns) -> Column:
    """Lengths of the column arrays that are present (a missing column is null)."""
    return F.filter(F.array(*[F.size(page[c]) for c in columns]), lambda s: s.isNotNull() & (s >= 0))


def uniform_lengths(page: Column, columns=INDEX_COLUMNS) -> Column:
    """AG-7: every present column array has the same length."""
    return F.size(F.array_distinct(_present_sizes(page, columns))) <= 1


def index_rows(pages: DataFrame, key_cols: list[str], page_col: str = "page",
               columns=INDEX_COLUMNS) -> tuple[DataFrame, DataFrame]:
    """SRC-1: ``(rows, rejects)``.  A missing column becomes nulls (SO-1); a
    page with unequal column lengths goes to rejects whole.  ``present_cols``
    lists the columns the row's page actually carried (absent differs from
    null for the per-index fallbacks of AG-1)."""
    page = F.col(page_col)
    tagged = pages.withColumn("_ok", F.coalesce(uniform_lengths(page, columns), F.lit(True)))
    rejects = tagged.where(~F.col("_ok")).select(*key_cols, F.lit("unequal column lengths").alias("reason"))
    ok = tagged.where(F.col("_ok"))
    n = F.coalesce(F.array_max(_present_sizes(page, columns)), F.lit(0))
    # one struct per position; a page without rows yields null, which inline skips
    rows = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
        i.alias("row_pos"), *[F.get(page[c], i).alias(c) for c in columns])))
    present = F.array_compact(F.array(*[F.when(page[c].isNotNull(), F.lit(c)) for c in columns]))
    out = ok.select(*key_cols, present.alias("present_cols"), F.inline(rows))
    return out, rejects


def normalise(rows: DataFrame) -> DataFrame:
    """PRJ-1 + types: default document name, parsed dates."""
    return (rows.withColumn("primaryDocument", document_or_default("primaryDocument"))
            .withColumn("filing_date", F.col("filingDate").try_cast("date"))
            .withColumn("meeting_date", F.col("meetingDate").try_cast("date")))


def older_pages_for_year(files: DataFrame, key_cols: list[str], year: int) -> DataFrame:
    """SRC-2: older index pages whose date span overlaps ``year``.

    ``files`` has key_cols + ``files`` (array of page references).  A page is
    kept when filingFrom's year <= year <= filingTo's year; a missing
    filingTo keeps the page.
    """
    ex = files.select(*key_cols, F.explode("files").alias("f")).select(*key_cols, "f.*")
    y_from, y_to = year_of_text("filingFrom"), year_of_text("filingTo")
    return ex.where((F.coalesce(y_from, F.lit(year)) <= year) & (F.coalesce(y_to, F.lit(year)) >= year))


def company_pages(raw: DataFrame, year: int | None = None) -> tuple[DataFrame, DataFrame]:
    """SRC-2 within the flows: ``(pages, rejects)`` of index files as read.

    Pages are ``(cik, page, source_file)``.  A file that names its company is
    that company's page.  An older page does not; the index that lists its
    file name does.  With ``year``, listed pages whose span misses it go before
    their columns are checked or turned into rows (the files themselves are
    still scanned).  A page without a company that no index lists is a reject.
    A file listed by several companies is a page of each.
    """
    named = raw.where(F.col("cik").isNotNull())
    refs = named.select("cik", F.explode("filings.files").alias("f")) \
        .select(F.col("cik").alias("_cik"), F.col("f.name").alias("_name"), "f.filingFrom", "f.filingTo")
    meets = F.lit(True)
    if year is not None:
        meets = (F.coalesce(year_of_text("filingFrom"), F.lit(year)) <= year) \
            & (F.coalesce(year_of_text("filingTo"), F.lit(year)) >= year)
    refs = refs.groupBy("_cik", "_name").agg(F.max(meets).alias("_meets"))
    older = raw.where(F.col("cik").isNull()).select(
        page_struct(raw).alias("page"), "source_file", F.element_at(F.split("source_file", "/"), -1).alias("_name"))
    older = older.join(refs, "_name", "left")
    pages = named.select("cik", page_struct(raw).alias("page"), "source_file").unionByName(
        older.where("_meets").select(F.col("_cik").alias("cik"), "page", "source_file"))
    rejects = older.where(F.col("_cik").isNull()).select(
        F.col("_cik").alias("cik"), "source_file", F.lit("page of no listed company").alias("reason"))
    return pages, rejects


def union_pages(*frames: DataFrame) -> DataFrame:
    """SO-1: union by column name; a column missing on one side becomes null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
