"""JSON encode / decode with explicit schemas (SC-15, UD-7)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from filingflow.functions.common import as_col as _col
from pyspark.sql.types import StructType


def parse_json(c, schema: StructType | str) -> Column:
    """Permissive parse: malformed text -> null fields and ``_corrupt_record`` set
    (when the schema declares that column)."""
    return F.from_json(_col(c), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})


def json_long(c, path: str) -> Column:
    """One integer field by JSON path; null when missing or not an integer."""
    return F.get_json_object(_col(c), path).try_cast("bigint")


def to_json_text(*cols) -> Column:
    return F.to_json(F.struct(*cols))
