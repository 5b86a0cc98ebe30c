"""Toxicity by a classifier chain over categories.

The categories are predicted one after the other.  Each has a ridge logistic
model of the words a text holds, and of the log-odds that the models before it
give the text.  Those are out-of-fold in training: a category's log-odds for a
training text come from models fitted without the text's fold, so later models
learn from earlier predictions as good as those they will see.

Words and the first ``STEMS`` bytes of longer words are hashed into
``1 << BITS`` features.  The models use, per category, the ``FEATURES`` whose
share of texts with the category differs most from that without, in standard
errors, by grouped counts over the sample: at most ``LABELLED`` labelled texts,
those of least hash.  All texts are scored whole.

``op6`` has three categories.  ``labels`` knows two, bad quality and toxic; the
third, severe, holds the toxic texts of the sample with at least the median
share of words that mark toxicity there.

Defined results: null texts and texts without words have probability 0 in every
category; a category whose labels are of one kind only, or that has none, is
given its share in the sample (0 if there is no sample) for texts with words; a
label that is null leaves its row out of the sample; rows are independent, so
repeated rows and ids repeat their result; other columns are carried along,
those named like a result column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filingflow.llm.logistic import fit_sparse
from filingflow.llm.store import Scratch
from filingflow.llm.textblocks import LOWER, blocks, prefix_hash, span_hash, word_spans

BITS, STEMS, FEATURES, LABELLED, FOLDS = 20, (4, 5, 6, 7, 8), 1500, 12_000, 4
LEAST_TEXTS, RIDGE = 4, 0.1
#: A text is toxic from this probability on.
TOXIC = 0.5

# Words are runs of ASCII letters and digits and of bytes beyond ASCII.
_GAP = np.ones(256, bool)
_GAP[48:58] = _GAP[65:91] = _GAP[97:123] = _GAP[128:] = False


def word_features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, text) of all words and stems, and the number of words of each text."""
    buf = LOWER[buf]
    start, end, owner = word_spans(buf, offs, _GAP)
    prefix = prefix_hash(buf)
    shift = np.uint64(64 - BITS)
    whole = span_hash(prefix, start, end) >> shift
    feature, text = [whole], [owner]
    for n in STEMS:
        long = np.flatnonzero(end - start > n)
        feature.append((span_hash(prefix, start[long], start[long] + n) ^ np.uint64(0x5DEECE66D << 20)) >> shift)
        text.append(owner[long])
    return np.concatenate(feature).astype(np.int64), np.concatenate(text), np.bincount(owner, minlength=len(offs) - 1)


def _distinct(batches):
    for batch in batches:
        for a, b, buf, offs in blocks(batch.column("text")):
            f, t, words = word_features(buf, offs)
            key = np.unique(t << BITS | f)
            cuts = np.searchsorted(key >> BITS, np.arange(b - a + 1))
            keep = words > 0
            column = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(key & ((1 << BITS) - 1), pa.int32()))
            rows = pa.RecordBatch.from_arrays([batch.column("row").slice(a, b - a), batch.column("y").slice(a, b - a), column, pa.array(words)], ["row", "y", "features", "words"])
            yield rows.filter(pa.array(keep))


@dataclass
class Chain:
    categories: list[str]
    place: np.ndarray  # feature -> column, or the number of columns
    weights: list[np.ndarray]  # per category: columns, earlier log-odds, intercept

    def log_odds(self, feature: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
        """texts x categories"""
        column = self.place[feature]
        columns = int(self.place.max(initial=0))
        used = column < columns
        key = np.unique(text[used] * columns + column[used])
        row, column = key // columns if columns else key, key % columns if columns else key
        out = np.zeros((texts, len(self.categories)))
        for k, w in enumerate(self.weights):
            out[:, k] = np.bincount(row, w[:columns][column], texts) + out[:, :k] @ w[columns:-1] + w[-1]
            out[:, k] = np.clip(out[:, k], -30, 30)
        return out


def _constant(y: np.ndarray, width: int) -> np.ndarray:
    share = np.clip(y.mean() if len(y) else 0.0, 1e-9, 1 - 1e-9)
    return np.append(np.zeros(width), np.log(share / (1 - share)))


def train_chain(row: np.ndarray, column: np.ndarray, y: np.ndarray, columns: int, fold: np.ndarray) -> list[np.ndarray]:
    """Weights of each category of y (texts x categories), in order."""
    texts, earlier, weights = len(y), np.zeros((len(y), 0)), []
    for k in range(y.shape[1]):
        def fit(use, k=k, earlier=earlier):
            if len(set(y[use, k].tolist())) < 2:
                return _constant(y[use, k], columns + k)
            number = np.cumsum(use) - 1
            inside = use[row]
            return fit_sparse(number[row[inside]], column[inside], earlier[use], y[use, k], columns, RIDGE)

        weights.append(fit(np.ones(texts, bool)))
        if k + 1 < y.shape[1]:
            out = np.zeros(texts)
            for f in range(FOLDS):
                w, held = fit(fold != f), fold == f
                out[held] = (np.bincount(row, w[:columns][column], texts) + earlier @ w[columns:-1] + w[-1])[held]
            earlier = np.column_stack([earlier, np.clip(out, -30, 30)])
    return weights


def train(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, categories: list[str], severe_of: str | None = None) -> Chain:
    """The chain in the order of ``categories``, 0/1 columns of ``labels``; ``severe_of`` adds "severe" for that category at the end."""
    spark = df.sparkSession
    given = labels.select(F.col(id_col).alias("id"), F.array(*(F.col(c).cast("int") for c in categories)).alias("y")).where(F.col("id").isNotNull() & F.forall("y", lambda x: x.isNotNull()))
    sample = given.orderBy(F.xxhash64("id"), "id", "y").limit(LABELLED)
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    # the sample is bounded by LABELLED rows
    rows = texts.join(F.broadcast(sample), "id").select(F.xxhash64("id", "text").alias("row"), "y", "text").limit(2 * LABELLED)
    scratch = Scratch(spark, "toxicity")
    rows = scratch.put(rows.mapInArrow(_distinct, "row long, y array<int>, features array<int>, words long"), "sample")
    n = len(categories)
    count = rows.agg(F.count("*").alias("n"), *(F.sum(F.col("y")[k]).alias(f"y{k}") for k in range(n))).first()
    total = count["n"]
    per_feature = rows.select(F.explode("features").alias("f"), "y").groupBy("f").agg(F.count("*").alias("texts"), *(F.sum(F.col("y")[k]).alias(f"y{k}") for k in range(n))).where(F.col("texts") >= LEAST_TEXTS)
    chosen: set[int] = set()
    marks: set[int] = set()
    for k in range(n if total else 0):
        with_, without = float(count[f"y{k}"] or 0), float(total - (count[f"y{k}"] or 0))
        a, b = F.col(f"y{k}") + 0.5, F.col("texts") - F.col(f"y{k}") + 0.5
        difference = F.log(a / (with_ + 1)) - F.log(b / (without + 1))
        z = difference / F.sqrt(1 / a + 1 / b)
        top = per_feature.select("f", z.alias("z")).orderBy(F.abs("z").desc(), "f").limit(FEATURES).collect()
        chosen |= {r.f for r in top}
        if categories[k] == severe_of:
            marks = {r.f for r in top if r.z > 5}
    features = np.array(sorted(chosen), np.int64)
    place = np.full(1 << BITS, len(features), np.int32)
    place[features] = np.arange(len(features))
    wanted = spark.createDataFrame([(int(f),) for f in features], "f int")
    held = rows.select("row", F.explode("features").alias("f")).join(F.broadcast(wanted), "f")  # at most FEATURES rows a category
    held = rows.select("row", "y", "words").join(held.groupBy("row").agg(F.collect_set("f").alias("fs")), "row", "left").orderBy("row").collect()
    y = np.array([r.y for r in held], float).reshape(len(held), n)
    row = np.repeat(np.arange(len(held)), [len(r.fs or ()) for r in held])
    found = np.array([f for r in held for f in sorted(r.fs or ())], np.int64)
    names = list(categories)
    if severe_of:
        share = np.bincount(row, np.isin(found, list(marks)), len(held)) / np.maximum([r.words for r in held], 1)
        of = y[:, categories.index(severe_of)] == 1
        y = np.column_stack([y, of & (share >= np.median(share[of]))]) if of.any() else np.column_stack([y, np.zeros(len(held))])
        names.append("severe")
    fold = np.array([r.row % FOLDS for r in held], np.int64)
    scratch.drop("sample")
    return Chain(names, place, train_chain(row, place[found], y, len(features), fold))


def score(df: DataFrame, chain: Chain, text_col: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """Add the probability p_<category> of every category."""
    results = [f"p_{c}" for c in chain.categories]
    keep = [f for f in df.schema.fields if f.name not in (*drop, *results)]
    names = [f.name for f in keep]
    shipped = df.sparkSession.sparkContext.broadcast(chain)  # 1 << BITS columns and a few thousand weights

    def run(batches):
        chain = shipped.value
        for batch in batches:
            p = np.zeros((len(batch), len(results)))
            for a, b, buf, offs in blocks(batch.column(text_col)):
                f, t, words = word_features(buf, offs)
                p[a:b] = np.where(words[:, None] > 0, 1 / (1 + np.exp(-chain.log_odds(f, t, b - a))), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(x) for x in p.T], names + results)

    return df.mapInArrow(run, T.StructType(keep + [T.StructField(c, T.DoubleType()) for c in results]))


def op6_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of all categories for every document, and whether it is toxic."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", (1 - F.col("quality")).alias("bad_quality"), "toxic")
    chain = train(docs, labels, "doc_id", "text", ["bad_quality", "toxic"], severe_of="toxic")
    return score(docs, chain, "text", drop=("text",)).withColumn("toxic", F.col("p_toxic") >= TOXIC)
