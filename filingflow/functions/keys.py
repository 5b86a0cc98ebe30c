"""Key building and formatting (SC-1..SC-5, PRJ-1..PRJ-3, PRJ-7)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from filingflow.functions.common import as_col as _col

# Public archive URL root, default document name, key widths.
ARCHIVE_BASE = "https://www.sec.gov/Archives/edgar/data"
DEFAULT_DOCUMENT = "primary_doc.htm"
CIK_WIDTH = 10


def pad_cik(c) -> Column:
    """SC-1: zero-pad to 10 characters, never truncating longer values."""
    s = _col(c).cast("string")
    return F.when(F.length(s) < CIK_WIDTH, F.lpad(s, CIK_WIDTH, "0")).otherwise(s)


def cik_number(c) -> Column:
    """SC-2: numeric CIK (leading zeros dropped); null when not a number."""
    return _col(c).try_cast("bigint")


def document_or_default(c) -> Column:
    """PRJ-1: missing or null document name -> primary_doc.htm."""
    return F.coalesce(_col(c), F.lit(DEFAULT_DOCUMENT))


def archive_url(cik, accession, document, base: str = ARCHIVE_BASE) -> Column:
    """PRJ-2: <base>/<cik without zeros>/<accession without dashes>/<document>."""
    return F.concat_ws("/", F.lit(base), cik_number(cik).cast("string"),
                       F.replace(_col(accession), F.lit("-"), F.lit("")), _col(document))


def proxy_id(cik, accession) -> Column:
    """PRJ-3: filing key ``<cik>_<accession>``."""
    return F.concat_ws("_", _col(cik), _col(accession))


def object_key(*parts) -> Column:
    """PRJ-3: slash-joined object key from columns or literals."""
    return F.concat_ws("/", *[p if isinstance(p, Column) else F.lit(p) for p in parts])


def long_date(c) -> Column:
    """SC-5: ``June 05 2025`` (full month name, 2-digit day, 4-digit year)."""
    return F.date_format(_col(c), "MMMM dd yyyy")


def iso_timestamp(c) -> Column:
    """PRJ-7: ISO-8601 text of a timestamp."""
    return F.date_format(_col(c), "yyyy-MM-dd'T'HH:mm:ss")


def year_of_text(c) -> Column:
    """SC-4: first four characters as an integer year (null when not numeric)."""
    return F.substring(_col(c), 1, 4).try_cast("int")


def year_range(c, year: int) -> Column:
    """FLT-1: half-open date range [year-01-01, year+1-01-01).

    Unlike ``year(c) = Y`` this is a plain range on the column, so it reaches
    the parquet reader as a pushed filter.
    """
    col = _col(c)
    return (col >= F.lit(f"{year}-01-01").cast("date")) & (col < F.lit(f"{year + 1}-01-01").cast("date"))


def first_truthy(*cols) -> Column:
    """SC-16: first string that is neither null nor empty.  Strings name
    columns; pass literal defaults as ``F.lit(...)``."""
    return F.coalesce(*[F.nullif(_col(c), F.lit("")) for c in cols])
