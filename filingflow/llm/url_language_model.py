"""URL filter: rules first, then the ratio of two character language models.

Rules give some urls a verdict.  Those urls teach two smoothed variable-order
Markov models of host and path, one of accepted and one of rejected urls:
Witten-Bell interpolation of contexts of 0 to ``ORDER`` characters.  A url that
no rule fits is judged by its log-likelihood difference per character, set
against a threshold that a logistic calibration finds on the quarter of the
ruled urls that the models have not seen.

All of it is grouping and joining: equal (host, path) are merged first, the
difference of a character depends only on the window of ``ORDER + 1``
characters that ends in it, so counts, probabilities and scores are tables
keyed by such windows and no model is broadcast.  Windows that most urls share
are one row of a grouped table; the join that adds up scores leaves frequent
windows to Spark's skew splitting.  Scores are summed in millionths, as whole
numbers, so that they do not depend on the order of rows.

Defined results: a null url or one without ``://`` has empty host and path;
empty host and path, or nothing to learn one of the models from, gives
``allow``; rows are independent, so repeated rows and ids repeat their result;
other columns are dropped, except the id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filingflow.llm.store import Scratch

ORDER = 4
ALLOW, BLOCK = "allow", "block"
#: Characters that may come next, for the uniform distribution below order 0.
ALPHABET = 256
MAX_RULES = 500
_PAD = "\x02" * ORDER
_UNIT = 1e6

RULES = [(ALLOW, "com/"), (BLOCK, "example.com/en/"), (ALLOW, "www.example.com/en/"), (BLOCK, "net/es/"), (BLOCK, "net/fr/")]


def host_of(url: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), upper, upper.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits; null if none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules: join them instead")
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        found = F.when(fits, rule).otherwise(found)
    return found


def _windows(sites: DataFrame) -> DataFrame:
    text = F.concat(F.lit(_PAD), F.col("site"))
    last = F.explode(F.sequence(F.lit(1), F.length("site")))
    return (sites.where(F.length("site") > 0).select("*", text.alias("padded"), last.alias("at"))
            .select("site", "label", "train", "n", F.expr(f"substring(padded, at, {ORDER + 1})").alias("w")))


def _log_ratios(windows: DataFrame) -> DataFrame:
    """(w, log2 of accepted over rejected probability of its last character)."""
    seen = F.when(F.col("train"), F.col("n")).otherwise(0)
    grams = [windows.groupBy("w").agg(*(F.sum(F.when(F.col("label") == v, seen).otherwise(0)).alias(v) for v in (ALLOW, BLOCK)))]
    for _ in range(ORDER):  # shorter by the first character each time
        grams.append(grams[-1].groupBy(F.expr("substring(w, 2)").alias("w")).agg(*(F.sum(v).alias(v) for v in (ALLOW, BLOCK))))
    smoothed = None
    for k, gram in enumerate(reversed(grams)):  # k characters of context
        context = gram.groupBy(F.expr(f"substring(w, 1, {k})").alias("context")).agg(
            *(F.sum(v).alias(f"n_{v}") for v in (ALLOW, BLOCK)), *(F.sum((F.col(v) > 0).cast("long")).alias(f"t_{v}") for v in (ALLOW, BLOCK)))
        rows = gram.withColumn("context", F.expr(f"substring(w, 1, {k})")).join(context, "context")
        if smoothed is not None:
            rows = rows.withColumn("shorter", F.expr("substring(w, 2)")).join(smoothed, "shorter")

        def p(v, first=smoothed is None):
            below = F.lit(1.0 / ALPHABET) if first else F.col(f"p_{v}")
            n, t = F.col(f"n_{v}"), F.col(f"t_{v}")
            return F.when(n > 0, (F.col(v) + t * below) / (n + t)).otherwise(below)

        out = rows.select("w", p(ALLOW).alias("q_a"), p(BLOCK).alias("q_b"))
        smoothed = out.select(F.col("w").alias("shorter"), F.col("q_a").alias(f"p_{ALLOW}"), F.col("q_b").alias(f"p_{BLOCK}"))
    return out.select("w", F.round(F.log2(F.col("q_a") / F.col("q_b")) * _UNIT).cast("long").alias("ratio"))


def calibrate(scores: np.ndarray, accepted: np.ndarray, rejected: np.ndarray) -> float:
    """Score at which a logistic curve through the weighted scores gives even odds."""
    if not accepted.sum() or not rejected.sum():
        return 0.0
    x = np.stack([np.ones(len(scores)), scores], 1)
    weight, beta = accepted + rejected, np.zeros(2)
    ridge = np.diag([1e-6, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + ridge, x.T @ (accepted - weight * p) - ridge @ beta)
        beta += step
        if abs(step).max() < 1e-9:
            break
    return float(np.clip(-beta[0] / beta[1], scores.min(), scores.max())) if beta[1] > 1e-9 else 0.0


def judge(df: DataFrame, url_col: str, id_col: str, rules: list[tuple[str, str]]) -> DataFrame:
    """(id, host, path, rule, verdict, score, threshold) of every row."""
    spark = df.sparkSession
    scratch = Scratch(spark, "url-model")
    parsed = df.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    sites = parsed.groupBy("host", "path").agg(F.count("*").alias("n"))
    rule = longest_rule(F.col("host"), F.col("path"), rules)
    label = F.coalesce(*(F.when(F.col("rule") == r, v) for v, r in rules), F.lit(None).cast("string")) if rules else F.lit(None).cast("string")
    site = F.concat("host", "path")
    sites = scratch.put(sites.withColumn("rule", rule).withColumn("label", label).withColumn("site", site)
                        .withColumn("train", F.crc32("site") % 4 != 0), "sites")
    windows = _windows(sites)
    ratios = scratch.put(_log_ratios(windows), "ratios")
    score = (F.sum("ratio") / F.count("*") / _UNIT).alias("score")
    scored = windows.select("site", "w").join(ratios, "w").groupBy("site").agg(score)
    # a site text has one score, whichever way host and path share it
    scored = scratch.put(sites.select("host", "path", "rule", "label", "train", "n", "site").join(scored, "site", "left"), "scores")
    held = (scored.where(F.col("label").isNotNull() & ~F.col("train") & F.col("score").isNotNull())
            .groupBy((F.round(F.col("score") * 100) / 100).alias("score"))
            .agg(*(F.sum(F.when(F.col("label") == v, F.col("n")).otherwise(0)).alias(v) for v in (ALLOW, BLOCK))).collect())  # hundredths: scores are within +-60
    teaches = {r.label for r in scored.where("train and score is not null").select("label").distinct().collect()}
    both = {ALLOW, BLOCK} <= teaches
    threshold = calibrate(*(np.array([r[c] for r in held], float) for c in ("score", ALLOW, BLOCK))) if held else 0.0
    by_model = F.when(F.lit(both) & (F.col("score") < threshold), BLOCK).otherwise(ALLOW)
    verdicts = scored.select("host", "path", "rule", F.coalesce("label", by_model).alias("verdict"), "score", F.lit(threshold).alias("threshold"))
    out = scratch.put(parsed.join(verdicts, ["host", "path"]).select(id_col, "host", "path", "rule", "verdict", "score", "threshold"), "verdicts")
    scratch.drop("sites", "ratios", "scores")
    return out


def op1_url_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, "url", "page_id", RULES)
