"""Quality classifier: document evidence combined with site posteriors, by hierarchical empirical Bayes.

A ridge logistic model of surface statistics (transitions between character
classes, repetition of words and lines, lengths) is fitted on at most
``LABELLED`` labelled documents, those of least hash.  Its log-odds less the
log-odds of the sample are a document's own evidence.

Expected good documents are summed per host and per path of a host (grouped
sums, so a host with a third of all rows is no special case).  The rate of a
host is shrunk towards the global rate, and that of a path towards its host's;
how much is estimated from how far rates differ beyond chance (the moments of
a beta-binomial), so a site with few documents says little.  A document is
left out of its own site's sums.  Its posterior log-odds are its evidence plus
the log-odds of its path; at ``KEEP`` and above it is kept.

Defined results: null texts and texts without words score 0 and are not kept;
a null host or path is the group of the empty string; rows are independent
otherwise, so repeated rows and ids repeat their result; with labels of one
kind only, or none, all texts with words are kept with score 1; other columns
are carried along, those named like a result column are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filingflow.llm.logistic import fit_dense
from filingflow.llm.store import Scratch
from filingflow.llm.textblocks import LOWER, blocks, prefix_hash, span_hash, word_spans

LABELLED = 12_000
KEEP = 0.5
#: Bounds of the shrinkage, in documents.
LEAST, MOST = 2.0, 10_000.0

# Classes: 0 other ASCII, 1 lower case, 2 upper case, 3 digit, 4 blank, 5 line end, 6 common punctuation, 7 beyond ASCII.
CLASS = np.zeros(256, np.uint8)
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[[32, 9]], CLASS[[10, 13]], CLASS[128:] = 1, 2, 3, 4, 5, 7
CLASS[[ord(c) for c in ".,;:'\"-()?"]] = 6
_LINE = np.zeros(256, bool)
_LINE[10] = True
FEATURES = 64 + 7


def _distinct(h: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return np.bincount(owner[new], minlength=texts)


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts x FEATURES, number of words)"""
    texts = len(offs) - 1
    size = np.diff(offs)
    owner = np.repeat(np.arange(texts), size)
    kind = CLASS[buf].astype(np.int64)
    same = owner[1:] == owner[:-1]
    pairs = np.bincount((owner[:-1] * 64 + kind[:-1] * 8 + kind[1:])[same], minlength=texts * 64).reshape(texts, 64)
    lower = LOWER[buf]
    prefix = prefix_hash(lower)
    start, end, who = word_spans(lower, offs)
    words = np.bincount(who, minlength=texts)
    kinds = _distinct(span_hash(prefix, start, end), who, texts)
    line_start, line_end, line_who = word_spans(lower, offs, _LINE)
    lines = np.bincount(line_who, minlength=texts)
    line_kinds = _distinct(span_hash(prefix, line_start, line_end), line_who, texts)
    w, n = np.maximum(words, 1), np.maximum(lines, 1)
    out = np.empty((texts, FEATURES))
    out[:, :64] = np.sqrt(pairs / np.maximum(size - 1, 1)[:, None])
    out[:, 64] = np.log1p(words)
    out[:, 65] = kinds / w
    out[:, 66] = np.log(np.maximum(kinds, 1)) / np.log1p(w)
    out[:, 67] = line_kinds / n
    out[:, 68] = np.log1p(words / n)
    out[:, 69] = size / w
    out[:, 70] = np.sqrt(np.bincount(who, (end - start) ** 2, texts) / w)
    return out, words


def _feature_rows(batches):
    for batch in batches:
        for a, b, buf, offs in blocks(batch.column("text")):
            x, words = features(buf, offs)
            keep = np.flatnonzero(words > 0)
            yield pa.RecordBatch.from_arrays([batch.column("label").take(pa.array(a + keep)), pa.FixedSizeListArray.from_arrays(pa.array(x[keep].ravel()), FEATURES).cast(pa.list_(pa.float64()))], ["label", "x"])


class Classifier:
    """Log-odds beyond those of the labelled sample."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        self.beta = fit_dense((x - self.mean) / self.scale, y)
        self.base = float(np.log(y.sum() + 0.5) - np.log((1 - y).sum() + 0.5))

    def evidence(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.beta[:-1] + self.beta[-1] - self.base


def train(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> Classifier | None:
    """None if the labels are all of one kind."""
    good = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).where("id is not null and label is not null")
    sample = good.orderBy(F.xxhash64("id"), "id", "label").limit(LABELLED)
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    # the sample is bounded by LABELLED rows of 16 bytes
    rows = texts.join(F.broadcast(sample), "id").select("text", "label").mapInArrow(_feature_rows, "label double, x array<double>").limit(2 * LABELLED).collect()
    y = np.array([r.label for r in rows])
    if len(set(y.tolist())) < 2:
        return None
    return Classifier(np.array([r.x for r in rows]), y)


def _evidence(shipped, text_at: int, names: list[str]):
    def run(batches):
        model = shipped.value
        for batch in batches:
            evidence, has = np.zeros(len(batch)), np.zeros(len(batch), bool)
            for a, b, buf, offs in blocks(batch.column(text_at)):
                x, words = features(buf, offs)
                has[a:b] = words > 0
                evidence[a:b] = model.evidence(x) if model else 40.0
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(names))] + [pa.array(evidence), pa.array(has)], names + ["__evidence", "__words"])
    return run


def _strength(sums) -> float:
    """Documents that a prior weighs, from summed n (rate - prior)^2 over sites of n documents."""
    chance = sums["rate"] * (1 - sums["rate"])
    free = sums["sites"] - 1
    room = sums["n"] - sums["squares"] / sums["n"] - free
    if chance <= 0 or free < 1 or room <= 0:
        return MOST
    spread = (sums["deviation"] / chance - free) / room
    return float(np.clip(1 / spread - 1, LEAST, MOST)) if spread > 0 else MOST


def score(df: DataFrame, model: Classifier | None, text_col: str, host_col: str, path_col: str, carry_text: bool = True) -> DataFrame:
    """Add quality_score (posterior probability), evidence, site_rate and keep.

    Without ``carry_text`` the result lacks the text, and the texts are read
    once; with it they are read again for the result.
    """
    spark = df.sparkSession
    results = ["quality_score", "evidence", "site_rate", "keep"]
    fields = [f for f in df.schema.fields if f.name not in results and (carry_text or f.name != text_col)]
    names = [f.name for f in fields]
    shipped = spark.sparkContext.broadcast(model)
    schema = T.StructType(fields + [T.StructField("__evidence", T.DoubleType()), T.StructField("__words", T.BooleanType())])
    base = model.base if model else 0.0

    def judged(columns: list[str]) -> DataFrame:
        kinds = T.StructType([f for f in df.schema.fields if f.name in columns] + schema.fields[-2:])
        text_at = columns.index(text_col) if text_col in columns else len(columns)
        given = df.select(*columns) if text_col in columns else df.select(*columns, F.col(text_col).alias("__text"))
        return given.mapInArrow(_evidence(shipped, text_at, columns), kinds)

    def key(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    own = 1 / (1 + F.exp(-F.least(F.greatest(F.col("__evidence") + base, F.lit(-35.0)), F.lit(35.0))))
    scratch = Scratch(spark, "quality")
    every = judged(names) if carry_text else scratch.put(judged(names), "evidence")
    light = (judged([c for c in names if c in (host_col, path_col)]) if carry_text else every).where("__words")
    light = light.select(key(host_col).alias("__host"), key(path_col).alias("__path"), own.alias("p"))
    paths = scratch.put(light.groupBy("__host", "__path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "paths")
    hosts = paths.groupBy("__host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))

    def sums(sites, n, s, prior):
        deviation = F.col(n) * (F.col(s) / F.col(n) - prior) ** 2
        return sites.agg(F.sum(deviation).alias("deviation"), F.count("*").alias("sites"), F.sum(n).alias("n"), F.sum(F.col(n).cast("double") ** 2).alias("squares"), (F.sum(s) / F.sum(n)).alias("rate")).first()

    total = hosts.agg(F.sum("hs").alias("s"), F.sum("hn").alias("n")).first()
    rate = float(np.clip(total["s"] / total["n"], 1e-4, 1 - 1e-4)) if total["n"] else 0.5
    of_hosts = _strength(sums(hosts, "hn", "hs", F.lit(rate))) if total["n"] else MOST
    host_rate = (F.lit(rate * of_hosts) + F.col("hs")) / (of_hosts + F.col("hn"))
    both = paths.join(hosts.withColumn("hr", host_rate), "__host")
    of_paths = _strength(sums(both, "n", "s", F.col("hr"))) if total["n"] else MOST
    sites = scratch.put(both.select("__host", "__path", "n", "s", "hn", "hs"), "sites")
    rows = every.withColumns({"__host": key(host_col), "__path": key(path_col), "__p": own})
    joined = rows.join(sites.withColumnsRenamed({c: f"__{c}" for c in ("n", "s", "hn", "hs")}), ["__host", "__path"], "left")
    # without the document itself
    mine = F.when(F.col("__words"), F.col("__p")).otherwise(0.0)
    one = F.col("__words").cast("int")
    zero = F.lit(0.0)
    host = (rate * of_hosts + F.coalesce(F.col("__hs") - mine, zero)) / (of_hosts + F.coalesce(F.col("__hn") - one, zero))
    site = (host * of_paths + F.coalesce(F.col("__s") - mine, zero)) / (of_paths + F.coalesce(F.col("__n") - one, zero))
    site = F.least(F.greatest(site, F.lit(1e-4)), F.lit(1 - 1e-4))
    odds = F.col("__evidence") + F.log(site / (1 - site))
    probability = F.when(F.col("__words"), 1 / (1 + F.exp(-F.least(F.greatest(odds, F.lit(-35.0)), F.lit(35.0))))).otherwise(0.0)
    return joined.select(*names, probability.alias("quality_score"), F.col("__evidence").alias("evidence"), site.alias("site_rate"), (F.col("__words") & (probability >= KEEP)).alias("keep"))


def op7_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every document; the source is its host, the language its path."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels, "doc_id", "text", "quality")
    return score(docs.select("doc_id", "text", "source", "lang"), model, "text", "source", "lang", carry_text=False).select("doc_id", "quality_score", "evidence", "site_rate", "keep")
