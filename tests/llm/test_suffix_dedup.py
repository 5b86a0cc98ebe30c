import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from filingflow.llm import suffix_dedup as sd


def brute(texts, length):
    """Kept bytes and removed spans, by counting every window."""
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        cover = np.zeros(len(d) + 1, np.int64)
        for i in range(len(d) - length + 1):
            if count[d[i:i + length]] > 1:
                cover[i] += 1
                cover[i + length if i + length <= len(d) else -1] -= 1
        gone = np.cumsum(cover)[:len(d)] > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out.append((bytes(np.frombuffer(d, np.uint8)[~gone]), list(zip(edge[::2].tolist(), edge[1::2].tolist()))))
    return out


def compare(spark, texts, length, gram, **limits):
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(4)
    got = {r.doc_id: r for r in sd.remove_repeats(df, "doc_id", "text", length, gram, **limits).collect()}
    assert len(got) == len(texts)
    for i, (kept, spans) in enumerate(brute(texts, length)):
        assert bytes(got[i].kept_bytes) == kept and [tuple(s) for s in got[i].spans] == spans, i
        assert got[i].n_bytes == len((texts[i] or "").encode())


def random_texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 5)))
    passages = [" ".join(word() for _ in range(rng.choice([6, 14, 30]))) for _ in range(6)]
    texts = [None, "", "a", "x" * 500, "x" * 90, "abab" * 100]
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            parts.append(rng.choice(passages) if rng.random() < 0.4 else " ".join(word() for _ in range(rng.randrange(1, 20))))
        texts.append(" ".join(parts))
    return texts + texts[10:14] + [texts[20] + "!", "?" + texts[21]]


@pytest.mark.parametrize("limits", [{}, {"hot": 3, "shard": 5}])
def test_random_texts_equal_brute_force(spark, limits):
    compare(spark, random_texts(1), 40, 12, **limits)


def test_hot_anchor_over_many_shards(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(12))
    pairs = [" ".join(word() for _ in range(20)) for _ in range(8)]
    texts = [f"{' '.join(word() for _ in range(9))} {passage} {' '.join(word() for _ in range(9))}" for _ in range(40)]
    texts += [p[:60 + k] + passage + p[60:] for p in pairs for k in (0, 1, 0)]
    compare(spark, texts, 40, 12, hot=2, shard=4)


def test_rows_equal_in_id_and_text(spark):
    rows = [(1, "p" * 30 + "q" * 30), (1, "p" * 30 + "q" * 30), (None, "r1" * 40), (None, None), (2, "unique text of some length here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sd.remove_repeats(df, "doc_id", "text", 40, 12).collect()
    assert sorted((r.n_bytes, len(r.kept_bytes)) for r in got) == [(0, 0), (31, 31), (60, 0), (60, 0), (80, 0)]
    assert sd.remove_repeats(df.limit(0), "doc_id", "text").count() == 0


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = brute([d.text for d in docs], 200)
    got = {r.doc_id: r for r in sd.op4_suffix_array_dedup(spark, sf).collect()}
    assert len(got) == len(docs) and any(spans for _, spans in want)
    for d, (kept, spans) in zip(docs, want):
        n = len((d.text or "").encode())
        r = got[d.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest())


def test_suffix_groups_and_prefixes():
    rng = random.Random(2)
    for _ in range(30):
        contexts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 60))) for _ in range(rng.randrange(1, 6))]
        buf = np.frombuffer(b"".join(contexts), np.uint8)
        offs = np.cumsum([0] + [len(c) for c in contexts])
        end = np.repeat(offs[1:], np.diff(offs))
        sa, rank = sd.suffix_groups(buf, end, 64)
        suffix = [bytes(buf[p:end[p]]) for p in range(len(buf))]
        assert [suffix[p] for p in sa] == sorted(suffix)
        shared = sd.common_prefixes(buf, end, sa, rank, offs[:-1], np.diff(offs), 64)
        for p in range(len(buf)):
            q = suffix[sa[rank[p] - 1]] if rank[p] else b""
            assert shared[p] == next((i for i, (x, y) in enumerate(zip(suffix[p], q)) if x != y), min(len(suffix[p]), len(q)))


def test_repeated_contexts_are_looked_up_by_a_semi_join(spark, monkeypatch):
    """A row of a context that many texts share is kept once; no join can multiply it by the context's other rows."""
    plans, put = {}, sd.Scratch.put

    def spy(self, df, label):
        plans[label] = df._jdf.queryExecution().optimizedPlan().toString()
        return put(self, df, label)
    monkeypatch.setattr(sd.Scratch, "put", spy)
    passage = "the same words in every text of a group, over and over"
    compare(spark, [f"{i * 7919:012d} {passage} {i * 104729:012d}" for i in range(50)], 40, 12)
    joins = [line for line in plans["found"].splitlines() if "Join" in line and "context" in line]
    assert joins and all("LeftSemi" in line for line in joins)


def test_contexts_of_one_block_go_on_once(spark, monkeypatch):
    """However often a passage stands in a block of texts, one row of each of its contexts meets the other blocks."""
    rows, put = {}, sd.Scratch.put

    def spy(self, df, label):
        got = put(self, df, label)
        if label in ("shared", "again"):
            rows[label] = got.collect()
        return got
    monkeypatch.setattr(sd.Scratch, "put", spy)
    passage = "the same words in every text of a group, over and over. "
    for texts in ([f"{i * 7919:012d} {passage} {i * 104729:012d}" for i in range(200)], [passage * 30, "-" + passage * 30, passage * 3, passage[5:50], None], [passage * 2] * 40):
        compare(spark, texts, 40, 12)
        most = Counter((r.gram, r.context) for r in rows["shared"])
        assert max(most.values()) <= 4  # the partitions, each of one block
        assert len(rows["again"]) <= len(texts)
