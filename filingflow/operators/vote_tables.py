"""Vote tallies read from the tables of a filing (UD-1, AG-6).

One Arrow pass over the pages reads the grids, aligns headers and yields a row's
texts by kind; counts, question ids and checks are column expressions on those.
Nothing shuffles and a table never meets another one.

* Header: the rows before the first one with a count beyond the first column.
  The label of a column is all its header texts, so a header that spans ("Votes
  cast" above "For") belongs to every column below it.  A text over the whole
  width is a caption and labels nothing.
* A vote table has a column *for* and one *against* or *withheld*; other tables
  (layout, accounts) yield nothing.
* A row's count of a kind is the first count in the columns of that kind; a dash,
  ``N/A`` or an empty cell is *not reported* (null).  Notes and shares behind a
  number (``(1)``, ``95.2 %`` in parentheses) go.  What is neither is kept as
  text and makes the row a reject.
* The resolution is the first cell that is not blank in the columns without a
  kind.  Its number ("Proposal 2", "Item 1a", "3. ...") is the question id, else
  ``<table>.<row>``, both from 1, rows from the first one with a count.
* Rows without any count or text of a kind (headings) are passed over.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filingflow.functions import html_tables
from filingflow.operators import quality, tallies

# What a column's label says, the first that fits.
KIND_PATTERNS = (
    ("broker_non_votes", r"(?i)broker|non-?\s*votes?\b"),
    ("abstentions", r"(?i)\babst"),
    ("against_votes", r"(?i)\bagainst\b|\bwithh[eo]ld"),
    ("for_votes", r"(?i)\bfor\b"),
    ("total_votes", r"(?i)\btotal\b"),
)
KINDS = tuple(k for k, _ in KIND_PATTERNS)
ROW_TYPE = T.StructType([T.StructField("table_no", T.IntegerType()), T.StructField("row_no", T.IntegerType()),
                         *(T.StructField(c, T.StringType()) for c in ("resolution", *KINDS))])
#: Pages whose rows a task holds at once.
PAGES_AT_ONCE = 500
_COUNT = r"^[0-9]{1,3}(,[0-9]{3})+$|^[0-9]+$"
_NOT_REPORTED = r"(?i)^([-‐-―*]+|n\.?/?a\.?|none)?$"
_NUMBERED = r"(?i)^(?:proposal|item|resolution)\s+(?:no\.?\s*|number\s+)?(\d{1,3}[a-z]?)\b|^(\d{1,2}[a-z]?)[.):]\s"


_NOTES = r"\([^)]*\)|[\s $]|(?<=\d)[*†‡]+$"

_kind_res = [(kind, re.compile(pattern)) for kind, pattern in KIND_PATTERNS]
_notes_re, _count_re, _not_reported_re = (re.compile(p) for p in (_NOTES, _COUNT, _NOT_REPORTED))


def parse_count(text: Column) -> Column:
    """``1,234`` -> 1234; null where the cell holds no whole number."""
    bare = F.regexp_replace(text, _NOTES, "")
    return F.when(bare.rlike(_COUNT), F.replace(bare, F.lit(","), F.lit("")).try_cast("bigint"))


def _is_count(text: str) -> bool:
    return bool(_count_re.search(_notes_re.sub("", text)))


def _label_kind(label: str) -> str | None:
    return next((kind for kind, pattern in _kind_res if pattern.search(label)), None)


def _first_shown(cells: list[str]) -> str | None:
    """The first cell with a count, else the first that reports something."""
    first = None
    for c in cells:
        if c.isascii() and c.isdigit():
            return c
        bare = _notes_re.sub("", c)
        if not _not_reported_re.search(bare):
            if _count_re.search(bare):
                return c
            first = c if first is None else first
    return first


def vote_rows(page: str) -> list[dict]:
    """Rows of a page's vote tables: ``table_no, row_no, resolution`` and the text of each kind."""
    out = []
    for table in html_tables.page_grids(page):
        rows = table["rows"]
        first = next((i for i, r in enumerate(rows) if any(_is_count(c) for c in r[1:])), 0)
        header = [r for r in rows[:first] if len(set(r)) > 1]
        width = max(map(len, header), default=0)
        kinds = [_label_kind(" ".join(r[c] for r in header if c < len(r))) for c in range(width)]
        if "for_votes" not in kinds or "against_votes" not in kinds:
            continue
        places = {kind: [c for c, k in enumerate(kinds) if k == kind] for kind in KINDS}
        for number, row in enumerate(rows[first:], 1):
            texts = {kind: _first_shown([row[c] for c in cols if c < len(row)]) for kind, cols in places.items()}
            if any(t is not None for t in texts.values()):
                named = (t for c, t in enumerate(row) if t and (c >= width or kinds[c] is None))
                out.append({"table_no": table["table_no"], "row_no": number, "resolution": next(named, None), **texts})
    return out


def _table_rows(pages: DataFrame, key_cols: list[str], html_col: str) -> DataFrame:
    """``key_cols`` and the rows of each page's vote tables, column by column."""
    schema = T.StructType([*pages.select(*key_cols).schema, *ROW_TYPE])

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), PAGES_AT_ONCE):
                part = batch.slice(lo, PAGES_AT_ONCE)
                found = [(i, r) for i, p in enumerate(part.column(len(key_cols)).to_pylist()) if isinstance(p, str) for r in vote_rows(p)]
                at = pa.array([i for i, _ in found], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(at) for c in range(len(key_cols))),
                     *(pa.array([r[f.name] for _, r in found], pa.int32() if f.name.endswith("_no") else pa.string()) for f in ROW_TYPE)],
                    schema.names)

    return pages.select(*key_cols, html_col).mapInArrow(run, schema)


def tagged_tallies(pages: DataFrame, key_cols: list[str], html_col: str = "html") -> DataFrame:
    """All rows of vote tables, ``reject_reason`` null where every count is one or not reported.

    Totals are computed (AG-6) for those; a reject keeps the counts that were read.
    Null and empty pages and pages without vote tables yield no rows.
    """
    rows = _table_rows(pages, key_cols, html_col)
    number = F.concat(F.regexp_extract("resolution", _NUMBERED, 1), F.regexp_extract("resolution", _NUMBERED, 2))
    place = F.concat_ws(".", F.col("table_no") + 1, "row_no")
    typed = rows.select(*key_cols, "table_no", "row_no", F.coalesce(F.nullif(F.lower(number), F.lit("")), place).alias("question_id"),
                        "resolution", *[F.col(k).alias(f"_raw_{k}") for k in KINDS], *[parse_count(F.col(k)).alias(k) for k in KINDS])
    tagged = quality.validate(typed, [(f"bad {k}", F.col(f"_raw_{k}").isNull() | F.col(k).isNotNull()) for k in KINDS])
    stated = F.col("total_votes")
    summed = tallies.with_totals(tagged.drop(*[f"_raw_{k}" for k in KINDS]).withColumn("_stated", stated))
    ok = F.col("reject_reason").isNull()
    return summed.withColumn("total_votes", F.when(ok, F.col("total_votes")).otherwise(F.col("_stated"))).drop("_stated")


def page_tallies(pages: DataFrame, key_cols: list[str], html_col: str = "html") -> tuple[DataFrame, DataFrame]:
    """``(tallies, rejects)`` of ``tagged_tallies``; persist its rows first when both are read."""
    return quality.split(tagged_tallies(pages, key_cols, html_col))
