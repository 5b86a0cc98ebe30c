"""Language identification: multinomial naive Bayes over hashed character n-grams.

Characters are lower-cased code points; all that are not letters count as one
space.  Every position of the whole text starts an n-gram of 1 to ``ORDERS``
characters, hashed into ``BUCKETS`` buckets.  Each task adds up its texts'
counts per label before anything is shuffled, Spark sums them over tasks, and
the log-probability matrix (labels x buckets, size checked) goes to the tasks
with the scoring function.

Defined results: text that is null or has no letter is ``und`` with score 0
and teaches nothing, and so is every text if there is nothing to learn from;
ties go to the label that sorts first; rows are independent, so repeated rows
and ids repeat their result; other columns are carried along, those named like
a result column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filingflow.llm.textblocks import blocks

ORDERS, BUCKET_BITS, SMOOTHING = 3, 15, 0.1
BUCKETS = 1 << BUCKET_BITS
#: The matrix that is broadcast holds at most this many labels (128 KB each).
MAX_LABELS = 500
NO_LETTERS = "und"


@dataclass
class Model:
    labels: list[str]
    log_probability: np.ndarray  # labels x buckets
    log_prior: np.ndarray


class Features:
    """Code points and n-gram buckets of a block of texts."""

    def __init__(self):
        self.letter = np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)
        self.lower = np.arange(0x110000, dtype=np.uint32)
        for c in np.flatnonzero(self.letter).tolist():
            low = chr(c).lower()
            if len(low) == 1:
                self.lower[c] = ord(low)
        self.lower[~self.letter] = 32

    def of(self, buf: np.ndarray, offs: np.ndarray):
        """(texts with letters, buckets, first bucket of each of those texts)."""
        data = buf.tobytes().decode("utf-8", "replace")
        lead = np.zeros(len(buf) + 1, np.int64)
        np.cumsum((buf & 0xC0) != 0x80, out=lead[1:])
        if lead[-1] != len(data):  # invalid UTF-8: text by text
            parts = [buf[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offs, offs[1:])]
            data, at = "".join(parts), np.cumsum([0] + [len(p) for p in parts])
        else:
            at = lead[offs]
        char = self.lower[np.frombuffer(data.encode("utf-32-le", "surrogatepass"), np.uint32)]
        space = char == 32
        letters = np.zeros(len(char) + 1, np.int64)
        np.cumsum(~space, out=letters[1:])
        has = letters[at[1:]] > letters[at[:-1]]
        owner_end = np.repeat(at[1:], np.diff(at))
        use = np.repeat(has, np.diff(at))
        position = np.arange(len(char))
        h = np.zeros(len(char), np.uint32)
        blank = np.ones(len(char), bool)
        found = []
        for n in range(ORDERS):
            live = len(char) - n
            if live <= 0:
                break
            h = (h[:live] + char[n:]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            blank = blank[:live] & space[n:]
            ok = use[:live] & ~blank & (position[:live] + n < owner_end[:live])
            found.append((position[:live][ok], ((h[ok] * np.uint32(0x85EBCA77) + np.uint32(n * 0x27D4EB2F)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int32)))
        return has, at, found


def _sums(label_col: str, text_col: str):
    def run(batches):
        features, counts, texts = Features(), {}, {}
        for batch in batches:
            labels = batch.column(label_col).to_pylist()
            for a, b, buf, offs in blocks(batch.column(text_col)):
                has, at, found = features.of(buf, offs)
                names = sorted(set(labels[a:b]))
                code = np.array([names.index(x) for x in labels[a:b]], np.int64)
                owner = np.repeat(code, np.diff(at))
                block = np.zeros(len(names) * BUCKETS, np.int64)
                for position, bucket in found:
                    block += np.bincount(owner[position] * BUCKETS + bucket, minlength=len(block))
                for i, name in enumerate(names):
                    if name not in counts:
                        counts[name], texts[name] = np.zeros(BUCKETS, np.int64), 0
                    counts[name] += block[i * BUCKETS:(i + 1) * BUCKETS]
                    texts[name] += int(has[code == i].sum())
        for name, c in counts.items():
            bucket = np.flatnonzero(c)
            bucket, n = np.append(bucket, -1), np.append(c[bucket], texts[name])  # -1: number of texts
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(n)), pa.array(bucket, pa.int32()), pa.array(n, pa.int64())], ["label", "bucket", "n"])
    return run


def fit(df: DataFrame, text_col: str, label_col: str) -> Model:
    """Learn from all rows with text and label."""
    rows = df.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull()).select(text_col, label_col)
    sums = rows.mapInArrow(_sums(label_col, text_col), "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    per_label = sums.groupBy("label").agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n"))
    found = {}
    for r in per_label.toLocalIterator():  # at most BUCKETS + 1 pairs a row
        if len(found) == MAX_LABELS:
            raise ValueError(f"more than {MAX_LABELS} labels")
        row = np.zeros(BUCKETS + 1)
        row[r.bucket] = r.n  # bucket -1, the number of texts, is the last
        if row[-1]:
            found[r.label] = row
    labels = sorted(found)
    table = np.array([found[x] for x in labels]).reshape(len(labels), BUCKETS + 1)
    counts, texts = table[:, :-1], table[:, -1]
    return Model(labels, np.log(counts + SMOOTHING) - np.log(counts.sum(1, keepdims=True) + SMOOTHING * BUCKETS), np.log(texts / max(texts.sum(), 1)))


def predict(df: DataFrame, model: Model, text_col: str, label_col: str = "lang_pred", score_col: str = "score", drop: tuple[str, ...] = ()) -> DataFrame:
    """Add the likeliest label of every whole text and its posterior probability; ``drop`` names columns to leave out."""
    keep = [f for f in df.schema.fields if f.name not in (*drop, label_col, score_col)]
    schema = T.StructType(keep + [T.StructField(label_col, T.StringType(), False), T.StructField(score_col, T.DoubleType(), False)])
    names = [f.name for f in keep]
    shipped = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model, features = shipped.value, Features()
        labels = np.array(model.labels + [NO_LETTERS], object)
        for batch in batches:
            best, score = np.full(len(batch), len(model.labels)), np.zeros(len(batch))
            for a, b, buf, offs in blocks(batch.column(text_col)) if model.labels else ():
                has, at, found = features.of(buf, offs)
                total = np.tile(model.log_prior[:, None], (1, b - a))
                for position, bucket in found:
                    cuts = np.searchsorted(position, at)
                    some = np.flatnonzero(cuts[1:] > cuts[:-1])
                    if len(some):
                        for i, row in enumerate(model.log_probability):
                            total[i, some] += np.add.reduceat(row[bucket], cuts[some])
                top = total.argmax(0)
                share = 1 / np.exp(total - total.max(0)).sum(0)
                best[a:b], score[a:b] = np.where(has, top, len(model.labels)), np.where(has, share, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(labels[best], pa.string()), pa.array(score)], names + [label_col, score_col])

    return df.mapInArrow(run, schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = fit(docs.where(~held_out), "text", "lang")
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return predict(rows, model, "text", drop=("text",))
