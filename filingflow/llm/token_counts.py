"""Token counts of sections, by offsets of the tokens of whole documents.

Every document is encoded once, as a whole.  The byte lengths of its tokens
give their byte offsets and, over the lead bytes of characters, their character
spans: a token that holds part of a character spans that character.  Sections
are character spans as well, in order and without overlap.  Both lists are
sorted, so the join of token spans with section spans is a bisection per
document, next to the text, and no token becomes a row.

A token that touches one section counts there.  One that touches several is
allocated by ``rule``: ``first``, to the first section it touches; ``most``, to
the one with most of its characters, the earlier if equal; ``share``, to each
by its share of the characters that lie in sections.  Tokens that touch no
section are counted with section -1.

Defined results: a null or empty text has no sections and no rows, nor has one
without tokens; invalid UTF-8 becomes U+FFFD before encoding; rows are
independent, so repeated rows and ids repeat their result; other columns are
carried along, those named like a result column are replaced.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from filingflow.llm.bpe_rank_queue import load_ranks

RULES = ("first", "most", "share")
_RESULTS = [T.StructField("section", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
            T.StructField("tokens", T.DoubleType()), T.StructField("crossing", T.LongType())]


def lines(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of the lines, each with its line end."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    end = np.flatnonzero(code == 10) + 1
    if len(code) and (not len(end) or end[-1] != len(code)):
        end = np.append(end, len(code))
    return np.append(0, end[:-1]) if len(end) else end, end


def token_spans(data: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of tokens of the given byte lengths."""
    buf = np.frombuffer(data, np.uint8)
    character = np.cumsum((buf & 0xC0) != 0x80) - 1  # of each byte
    end = np.cumsum(lengths)
    return character[end - lengths], character[end - 1] + 1


def allocate(start: np.ndarray, end: np.ndarray, section_start: np.ndarray, section_end: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens per section, the last for no section; tokens that touch several, per section they touch)"""
    n = len(section_start)
    first = np.searchsorted(section_end, start, "right")
    last = np.searchsorted(section_start, end, "left") - 1
    touched = last - first + 1
    out = np.bincount(np.where(touched >= 1, first, n)[touched <= 1], minlength=n + 1).astype(float)
    several = np.flatnonzero(touched > 1)
    crossing = np.zeros(n + 1, np.int64)
    if len(several):
        token = np.repeat(several, touched[several])
        offset = np.arange(len(token)) - np.repeat(np.cumsum(touched[several]) - touched[several], touched[several])
        section = first[token] + offset
        part = np.minimum(end[token], section_end[section]) - np.maximum(start[token], section_start[section])
        np.add.at(crossing, section, 1)
        if rule == "first":
            np.add.at(out, first[several], 1)
        elif rule == "most":
            order = np.lexsort((section, -part, token))
            best = np.append(True, token[order][1:] != token[order][:-1])
            np.add.at(out, section[order][best], 1)
        else:
            total = np.bincount(token, part, len(start))[token]
            np.add.at(out, section, part / total)
    return out, crossing


def section_tokens(df: DataFrame, text_col: str, ranks_path: str, pattern: str, rule: str = "most", sections: Callable[[str], tuple[np.ndarray, np.ndarray]] = lines, drop: tuple[str, ...] = ()) -> DataFrame:
    """One row per section with its span, tokens and crossing tokens, and the columns of its document (but ``drop``)."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    named = {f.name for f in _RESULTS}
    keep = [f for f in df.schema.fields if f.name not in drop and f.name not in named]
    names = [f.name for f in keep]
    shipped = df.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    def run(batches):
        ranks = shipped.value
        encode = tiktoken.Encoding(os.path.basename(ranks_path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        length = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        for token, rank in ranks.items():
            length[rank] = len(token)
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch = whole.slice(at, 1000)
                rows: list[list[np.ndarray]] = [[], [], [], [], [], []]
                for i, data in enumerate(batch.column(text_col).cast(pa.binary()).to_pylist()):
                    text = (data or b"").decode("utf-8", "replace")
                    if not text:
                        continue
                    start, end = token_spans(text.encode(), length[encode(text)])
                    a, b = sections(text)
                    count, crossing = allocate(start, end, a, b, rule)
                    n = len(a) + (count[-1] > 0)
                    for column, x in zip(rows, (np.full(n, i), np.append(np.arange(len(a)), -1)[:n], np.append(a, -1)[:n], np.append(b, -1)[:n], count[:n], crossing[:n])):
                        column.append(x)
                if rows[0]:
                    row, section, a, b, count, crossing = map(np.concatenate, rows)
                    row = pa.array(row)
                    yield pa.RecordBatch.from_arrays([batch.column(c).take(row) for c in names] + [pa.array(section, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(count, pa.float64()), pa.array(crossing, pa.int64())],
                                                     names + [f.name for f in _RESULTS])

    return df.mapInArrow(run, T.StructType(keep + _RESULTS))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return section_tokens(docs, "text", public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, drop=("text",))
