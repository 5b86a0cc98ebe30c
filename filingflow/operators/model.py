"""Pluggable model stages over Arrow batches (UD-1..UD-4, UD-6, UD-7).

A model is any Python callable ``fn(pandas.DataFrame) -> sequence of str``
returning one JSON document per input row (a hosted language model client, a
local model, or the deterministic stubs below).  ``apply_model`` runs it with
``mapInPandas``:

- Spark partitions and schedules the calls; ``repartition(n)`` before the
  stage bounds the concurrency a remote service sees (ST-4);
- a failing batch is retried row by row so one bad row only marks itself
  (``model_error``) and the others continue (ST-5);
- the JSON text is parsed and validated in the JVM with ``from_json`` and an
  explicit schema (UD-7); malformed rows land in ``_corrupt_record``.

Model output is not deterministic in general: persist it once (write the
table) and let downstream steps read the stored rows.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType

ModelFn = Callable[[pd.DataFrame], "list[str] | pd.Series"]


def apply_model(df: DataFrame, fn: ModelFn | None, input_cols: list[str], keep_cols: list[str],
                output_col: str = "model_output", error_col: str = "model_error",
                max_concurrency: int | None = None,
                factory: Callable[[], ModelFn] | None = None,
                retries: int = 2, backoff_seconds: float = 0.0, call_rows: int = 256) -> DataFrame:
    """Run ``fn`` over Arrow batches; returns keep_cols + output + error.

    ``factory`` builds the model once per task (a client with a connection
    pool, a local model loaded from disk) instead of shipping a built one.
    The model is called on slices of at most ``call_rows`` rows (bounded
    request size).  When a slice fails, each of its rows is tried alone up to
    ``retries`` times (``backoff_seconds`` apart); rows that still fail carry
    the error.
    """
    if fn is None and factory is None:
        raise ValueError("give fn or factory")
    src = df.select(*dict.fromkeys([*keep_cols, *input_cols]))
    if max_concurrency:
        src = src.repartition(max_concurrency)
    in_schema = src.schema
    out_schema = StructType([*[in_schema[c] for c in keep_cols],
                             StructField(output_col, StringType()), StructField(error_col, StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model_fn = factory() if factory is not None else fn
        for pdf in batches:
            # one slice after the other, so that a batch's outputs are never held together
            for lo in range(0, len(pdf), max(call_rows, 1)):
                part = pdf.iloc[lo:lo + max(call_rows, 1)]
                inp, n = part[input_cols], len(part)
                outs: list = [None] * n
                errs: list = [None] * n
                try:
                    res = list(model_fn(inp))
                    if len(res) != n:
                        raise ValueError(f"model returned {len(res)} outputs for {n} rows")
                    outs = res
                except Exception:  # noqa: BLE001 -- retry row by row, isolate failures
                    for i in range(n):
                        for attempt in range(max(retries, 1)):
                            try:
                                outs[i] = list(model_fn(inp.iloc[i:i + 1]))[0]
                                errs[i] = None
                                break
                            except Exception as e:  # noqa: BLE001
                                errs[i] = f"{type(e).__name__}: {e}"
                                if backoff_seconds and attempt + 1 < retries:
                                    time.sleep(backoff_seconds)
                res_pdf = part[keep_cols].copy()
                # models may hand back parsed objects; store JSON text either way
                res_pdf[output_col] = [o if o is None or isinstance(o, str) else json.dumps(o) for o in outs]
                res_pdf[error_col] = errs
                yield res_pdf

    return src.mapInPandas(run, out_schema)


def parse_output(df: DataFrame, schema: StructType, output_col: str = "model_output",
                 parsed_col: str = "parsed") -> DataFrame:
    """UD-7: parse model JSON with an explicit schema; malformed -> ``_corrupt_record``."""
    with_corrupt = StructType([*schema.fields, StructField("_corrupt_record", StringType())])
    return df.withColumn(parsed_col, F.from_json(F.col(output_col), with_corrupt, {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))


def parse_ok(parsed_col: str = "parsed", error_col: str = "model_error") -> Column:
    return (F.col(error_col).isNull() & F.col(parsed_col).isNotNull()
            & F.col(f"{parsed_col}._corrupt_record").isNull())


# ---------------------------------------------------------------------------
# Embedders (UD-4)

EMBED_DIM = 64
#: Text that one call of the embedder splits into words, in characters.
EMBED_CHARS = 1 << 20


def hashing_embedder(dim: int = EMBED_DIM) -> Callable[[pd.Series], pd.Series]:
    """Deterministic lexical embedder: signed hashed word counts, L2-normalised.

    A stand-in for a hosted embedding model with the same contract (text in,
    unit-length float vector out).  Vectorised per Arrow batch: all words of
    a slice of the batch are hashed in one call (fixed-key SipHash) and binned with
    one ``bincount``.
    """
    word = re.compile(r"\w+", re.UNICODE)

    def slice_vectors(texts: list) -> np.ndarray:
        toks = [word.findall(t.lower()) if isinstance(t, str) else [] for t in texts]
        n = len(toks)
        lens = np.fromiter((len(x) for x in toks), dtype=np.int64, count=n)
        if lens.sum() == 0:
            return np.zeros((n, dim), dtype=np.float32)
        flat = np.array([w for x in toks for w in x], dtype=object)
        h = pd.util.hash_array(flat, categorize=False)
        rows = np.repeat(np.arange(n, dtype=np.int64), lens)
        bucket = (h % np.uint64(dim)).astype(np.int64)
        sign = np.where((h >> np.uint64(63)) == 0, 1.0, -1.0)
        m = np.bincount(rows * dim + bucket, weights=sign, minlength=n * dim).reshape(n, dim)
        norms = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0).astype(np.float32)

    def embed(texts: pd.Series) -> pd.Series:
        # words are many times larger than their text: at most EMBED_CHARS of text at once, whatever the batch
        texts = list(texts)
        ends = np.cumsum([len(t) if isinstance(t, str) else 0 for t in texts]) // EMBED_CHARS
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1), len(texts)] if texts else []
        return pd.Series([v for lo, hi in zip(cuts, cuts[1:]) for v in slice_vectors(texts[lo:hi])], dtype=object)
    return embed


def embed_column(text_col: str | Column, embedder: Callable[[pd.Series], pd.Series] | None = None,
                 factory: Callable[[], Callable[[pd.Series], pd.Series]] | None = None) -> Column:
    """UD-4 as an iterator pandas UDF: text -> ``array<float>``.

    The embedder (or ``factory()``, e.g. loading a local model) is set up once
    per task and then applied to every Arrow batch of the task.
    """
    def _embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fn = factory() if factory is not None else (embedder or hashing_embedder())
        for s in batches:
            yield fn(s)
    udf = F.pandas_udf(_embed, ArrayType(FloatType()))
    return udf(F.col(text_col) if isinstance(text_col, str) else text_col)


def embed_texts_once(df: DataFrame, text_col: str, out_col: str = "embedding",
                     embedder: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """UD-4 with de-duplication: each distinct text is embedded once (keyed by
    a 128-bit hash), then joined back -- repeated boilerplate chunks across
    filings cost one model call."""
    keyed = df.withColumn("_th", F.coalesce(F.sha2(F.col(text_col), 256), F.lit("")))  # null texts share one call
    distinct = keyed.select("_th", text_col).dropDuplicates(["_th"])
    emb = distinct.select("_th", embed_column(text_col, embedder).alias(out_col))
    return keyed.join(emb, "_th").drop("_th")


# ---------------------------------------------------------------------------
# Deterministic stub models (tests and registered rows-only queries)

# The enums of the extraction contracts.
BOARD_VOTES = ("For", "Against", "Abstain", "Not Stated")
QUESTION_TYPES = ("board_composition", "compensation", "shareholder_rights",
                  "environmental_social", "transactions", "other")
RECOMMENDATIONS = ("For", "Against", "Abstain", "Withhold")

QUESTION_SCHEMA = StructType([
    StructField("proxy_questions", ArrayType(StructType([
        StructField("question_id", StringType()),
        StructField("question_text", StringType()),
        StructField("board_vote_recommendation", StringType()),
        StructField("question_type", StringType()),
        StructField("is_shareholder_proposal", StringType()),
    ]))),
])


_SENTENCE = re.compile(r"[^.!?\n]+[.!?]")


def _sentences(t: str | None) -> list[str]:
    return [m.group(0).strip() for m in _SENTENCE.finditer(t or "")]


def stub_question_model(text_col: str = "prompt", min_words: int = 24) -> ModelFn:
    """Emits every sentence of at least ``min_words`` words of the passages
    (the text after the prompt's first blank line), in document order."""
    def fn(pdf: pd.DataFrame) -> list[str]:
        out = []
        for t in pdf[text_col]:
            sents = _sentences((t or "").split("\n\n", 1)[-1])
            keep = [i for i, s in enumerate(sents) if len(s.split()) >= min_words]
            qs = []
            for n, i in enumerate(keep):
                s = sents[i]
                qs.append({"question_id": f"{n + 1}", "question_text": s,
                           "board_vote_recommendation": BOARD_VOTES[len(s) % 4],
                           "question_type": QUESTION_TYPES[len(s.split()) % 6],
                           "is_shareholder_proposal": "true" if len(s) % 2 else "false"})
            out.append(json.dumps({"proxy_questions": qs}))
        return out
    return fn


TALLY_SCHEMA = StructType([
    StructField("ticker", StringType()),
    StructField("meeting_date", StringType()),
    StructField("voting_results", ArrayType(StructType([
        StructField("questionId", StringType()),
        StructField("resolution", StringType()),
        StructField("total_votes", StringType()),
        StructField("for", StringType()),
        StructField("against", StringType()),
        StructField("abstentions", StringType()),
        StructField("broker_non_votes", StringType()),
    ]))),
])


def stub_tally_model(text_col: str = "text", ticker_col: str = "ticker",
                     date_col: str = "meeting_date") -> ModelFn:
    """Tallies of all sentences: sentence j feeds tally j mod 4; counts come
    from word lengths, the last tally has no broker non-votes."""
    def fn(pdf: pd.DataFrame) -> list[str]:
        out = []
        for t, tk, dt in zip(pdf[text_col], pdf[ticker_col], pdf[date_col]):
            sents = _sentences(t)
            res = []
            for i, group in enumerate(g for g in (sents[k::4] for k in range(4)) if g):
                words = [w for s in group for w in s.split()]
                res.append({"questionId": str(i + 1), "resolution": group[0],
                            "total_votes": None, "for": sum(len(w) for w in words), "against": len(words),
                            "abstentions": sum(len(s) for s in group) % 7,
                            "broker_non_votes": None if i == 3 else i})
            out.append(json.dumps({"ticker": tk, "meeting_date": dt, "voting_results": res}))
        return out
    return fn


REC_SCHEMA = StructType([
    StructField("question_id", StringType()),
    StructField("proxy_question", StringType()),
    StructField("voting_recommendation", StringType()),
    StructField("rationale", StringType()),
    StructField("citation", StringType()),
    StructField("confidence", StringType()),
    StructField("key_facts", StringType()),
    StructField("policy_breaches", StringType()),
])


def stub_recommendation_model(text_col: str = "prompt") -> ModelFn:
    """Recommendation derived from the size of the prompt's passages."""
    def fn(pdf: pd.DataFrame) -> list[str]:
        out = []
        for qid, q, ctx in zip(pdf["question_id"], pdf["proxy_question"], pdf[text_col]):
            n = (ctx or "").count(" ") + 1
            out.append(json.dumps({
                "question_id": qid, "proxy_question": q,
                "voting_recommendation": RECOMMENDATIONS[n % 4],
                "rationale": f"context of {n} words",
                "citation": max(_sentences(ctx), key=len, default=""),
                "confidence": round((n % 101) / 100, 2), "key_facts": f"{n} words", "policy_breaches": "none"}))
        return out
    return fn
