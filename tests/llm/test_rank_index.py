import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from filingflow.llm import rank_index as ri


def _boundaries(text):
    buf = np.frombuffer(text.encode(), np.uint8)
    return np.append(np.flatnonzero((buf & 0xC0) != 0x80), len(buf))


def test_index_is_exact_and_error_bounded():
    rng = random.Random(5)
    texts = ["", "a", "plain text " * 9000, "ж" * 70000, "a" * 3000 + "漢" * 3000 + "b" * 3000, "".join(rng.choice("aé漢😀") for _ in range(50000)),
             "".join("a" * rng.randrange(400) + "😀" * rng.randrange(400) for _ in range(200))]
    for text in texts:
        at = _boundaries(text)
        index = ri.RankIndex(at)
        assert np.array_equal(index.offset(np.arange(len(at))), at)
        assert len(index.residual) == len(at) and np.abs(index.residual.astype(int)).max() <= ri.ERROR + 1
        tight = ri.RankIndex(at, 2)
        assert np.array_equal(tight.offset(np.arange(len(at))), at) and len(tight.first) >= len(index.first)
    assert len(ri.RankIndex(_boundaries("plain text " * 9000)).first) == 1
    assert len(ri.RankIndex(_boundaries("ж" * 70000)).first) == 1


def test_segments_are_as_long_as_the_cone_allows():
    at = np.cumsum(np.random.default_rng(1).integers(1, 5, 3000))
    index = ri.RankIndex(at, 3)
    for first, after in zip(index.first, np.append(index.first[1:], len(at))):
        low, high = -np.inf, np.inf
        for r in range(first + 1, min(after + 1, len(at))):
            low, high = max(low, (at[r] - at[first] - 3) / (r - first)), min(high, (at[r] - at[first] + 3) / (r - first))
            assert (low <= high) == (r < after)


def _plain(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[k:k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted(x % (len(text) + 1) for x in h[:2])
    p, m, s = text[:a], text[a:b], text[b:]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(text), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(text), "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return len(text), "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_rows_equal_brute_force_and_texts_come_back(spark):
    rng = random.Random(2)
    texts = [None, "", "a", "<P> stays", "x<M>y", "< <S", "é" * 9, "漢字と😀 mixed", "<" * 50, "<S<S<P<M", "long ж " * 300_000] + ["".join(rng.choice("ab<PSM> é😀") for _ in range(rng.randrange(60))) for _ in range(300)]
    rows = [(i if i % 17 else None, t, "kept", f"clash{i}") for i, t in enumerate(texts)] + [(1, "same row", "kept", "c"), (1, "same row", "kept", "c"), (1, "other text", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, form string")
    out = ri.fill_in_middle(df, "doc_id", "text").withColumn("back", ri.restored(F.col("form"), F.col("output")))
    assert out.columns == ["doc_id", "lang", "n", "form", "prefix_chars", "middle_chars", "output", "back"]
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in out.collect()), key=repr)
    assert got == sorted(((d, *_plain(d, t), t or "") for d, t, *_ in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert ri.fill_in_middle(df.limit(0), "doc_id", "text").count() == 0


def test_parameters(spark):
    df = spark.createDataFrame([(i, "some text") for i in range(200)], "doc_id long, text string")
    assert {r.form for r in ri.fill_in_middle(df, "doc_id", "text", percent=0).collect()} == {"plain"}
    assert {r.form for r in ri.fill_in_middle(df, "doc_id", "text", percent=100, suffix_first=100).collect()} == {"spm"}
