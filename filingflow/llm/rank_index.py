"""Fill-in-middle texts, cut through a piecewise-linear learned rank index.

A cut names a rank, a number of code points; the text is bytes.  The index maps
the rank of every boundary between code points to its byte offset: greedy
segments, each the longest line from its first boundary that keeps all others
of the segment within ``ERROR`` bytes (a shrinking cone of slopes), and a
stored residual per boundary.  A cut finds its segment by bisection, predicts
the offset on the line and adds the residual, so it's exact.  One index spans a
block of texts; every boundary of the block is fitted.  Text of one-byte
characters is one segment, whatever its length.

The order of the three parts, and whether a text is cut at all, follow from a
hash of the row's id, so a run that repeats gives the same rows.

Defined results: a null or empty text has no units and is ``plain``; a null id
hashes as the empty string; rows are independent, so repeated rows repeat their
result and rows that share an id differ by their text only; columns named like
a result column are replaced, other columns are carried along.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filingflow.llm.textblocks import blocks

#: Bytes that a boundary may lie beside its line; a residual, rounding included, fits a signed byte.
ERROR = 100
#: Boundaries looked at in one step while a segment grows.
_FIRST_STEP, _LAST_STEP = 256, 1 << 16
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RESULT = ("n", "form", "prefix_chars", "middle_chars", "output")


class RankIndex:
    """Byte offsets of ascending boundaries by rank: segments and residuals."""

    def __init__(self, boundaries: np.ndarray, error: int = ERROR):
        first, slope, rank = [], [], 0
        while rank < len(boundaries):
            after, line = _longest_line(boundaries, rank, error)
            first.append(rank)
            slope.append(line)
            rank = after
        self.first = np.array(first, np.int64)
        self.start = boundaries[self.first] if first else np.empty(0, np.int64)
        self.slope = np.array(slope)
        size = np.diff(np.append(self.first, len(boundaries)))
        steps = np.arange(len(boundaries)) - np.repeat(self.first, size)
        line = np.repeat(self.start, size) + np.rint(np.repeat(self.slope, size) * steps).astype(np.int64)
        self.residual = (boundaries - line).astype(np.int8 if error < 127 else np.int64)

    def offset(self, rank: np.ndarray) -> np.ndarray:
        segment = np.searchsorted(self.first, rank, "right") - 1
        line = np.rint(self.slope[segment] * (rank - self.first[segment])).astype(np.int64)
        return self.start[segment] + line + self.residual[rank]


def _longest_line(boundaries: np.ndarray, rank: int, error: int) -> tuple[int, float]:
    """(first rank beyond the segment that starts at ``rank``, slope of its line)."""
    low, high, at, step = -np.inf, np.inf, rank + 1, _FIRST_STEP
    while at < len(boundaries):
        rise = boundaries[at:at + step] - boundaries[rank]
        run = np.arange(at - rank, at - rank + len(rise))
        lows = np.maximum(np.maximum.accumulate((rise - error) / run), low)
        highs = np.minimum(np.minimum.accumulate((rise + error) / run), high)
        beyond = np.flatnonzero(lows > highs)
        fits = int(beyond[0]) if len(beyond) else len(rise)
        if fits:
            low, high = lows[fits - 1], highs[fits - 1]
        at += fits
        if len(beyond):
            break
        step = min(2 * step, _LAST_STEP)
    return at, (low + high) / 2 if at > rank + 1 else 1.0


def _draws(ids: list, seed: str) -> np.ndarray:
    """rows x 4 unsigned integers from the hash of seed and id."""
    digests = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(digests, ">u4").astype(np.int64).reshape(len(ids), 4)


def fill_in_middle(df: DataFrame, id_col: str, text_col: str, seed: str = "1", percent: int = 90, suffix_first: int = 20) -> DataFrame:
    """Replace ``text_col`` by n, form, prefix_chars, middle_chars and output.

    ``percent`` of the texts are cut, ``suffix_first`` percent of these in the
    form ``spm``, the others as ``psm``.  Texts that hold a sentinel stay plain.
    """
    keep = [f for f in df.schema.fields if f.name not in (text_col, *RESULT)]
    schema = T.StructType(keep + [T.StructField("n", T.LongType(), False), T.StructField("form", T.StringType(), False), T.StructField("prefix_chars", T.LongType()),
                                  T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType(), False)])
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def run(batches):
        for batch in batches:
            ids = batch.column("_id").to_pylist()
            for a, b, buf, offs in blocks(batch.column("_text")):
                boundaries = np.append(np.flatnonzero((buf & 0xC0) != 0x80), len(buf))
                index = RankIndex(boundaries)
                rank = np.searchsorted(boundaries, offs)
                n = np.diff(rank)
                h = _draws(ids[a:b], seed)
                cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
                byte = index.offset(rank[:-1, None] + cuts)
                data = buf.tobytes()
                form, output = [], []
                for i, (start, one, two, end) in enumerate(zip(offs[:-1].tolist(), byte[:, 0].tolist(), byte[:, 1].tolist(), offs[1:].tolist())):
                    text = data[start:end]
                    if not text or h[i, 2] % 100 >= percent or p in text or s in text or m in text:
                        form.append("plain")
                        output.append(text)
                    elif h[i, 3] % 100 < suffix_first:
                        form.append("spm")
                        output.append(b"".join((s, data[two:end], p, data[start:one], m, data[one:two])))
                    else:
                        form.append("psm")
                        output.append(b"".join((p, data[start:one], s, data[two:end], m, data[one:two])))
                plain = np.array([f == "plain" for f in form])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(f.name).slice(a, b - a) for f in keep]
                    + [pa.array(n, pa.int64()), pa.array(form), pa.array(cuts[:, 0], pa.int64(), mask=plain), pa.array(cuts[:, 1] - cuts[:, 0], pa.int64(), mask=plain), pa.array(output, pa.binary()).cast(pa.string())],
                    [f.name for f in schema])

    return df.select(*(f.name for f in keep), F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, schema)


def restored(form: Column, output: Column) -> Column:
    """The text that ``output`` was made from, by its form and the sentinels alone."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    psm = F.concat(parts[1], parts[3], parts[2])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(F.concat(parts[2], parts[3], parts[1]))


def op12_fim_rank_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, cuts and digests of every document's fill-in-middle text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = fill_in_middle(docs, "doc_id", "text")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"))


OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
x AS (SELECT doc_id, t, length(t) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
y AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM x),
z AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM y)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM z
"""
