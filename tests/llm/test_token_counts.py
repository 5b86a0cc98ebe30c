import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from filingflow.llm import token_counts as tc
from filingflow.llm.bpe_rank_queue import load_ranks

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def lib():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(PATH), special_tokens={})


def brute(lib, text, a, b, rule):
    """Token by token, character by character."""
    out, crossing, at = [0.0] * (len(a) + 1), [0] * (len(a) + 1), 0
    owner = {}
    for c, ch in enumerate(text):
        for _ in ch.encode():
            owner[len(owner)] = c
    for token in lib.encode_ordinary(text):
        size = len(lib.decode_single_token_bytes(token))
        characters = sorted({owner[i] for i in range(at, at + size)})
        at += size
        held = [(s, sum(x <= c < y for c in characters)) for s, (x, y) in enumerate(zip(a, b))]
        held = [(s, k) for s, k in held if k]
        if not held:
            out[-1] += 1
            continue
        if len(held) > 1:
            for s, _ in held:
                crossing[s] += 1
        if rule == "first":
            out[held[0][0]] += 1
        elif rule == "most":
            out[max(held, key=lambda h: (h[1], -h[0]))[0]] += 1
        else:
            for s, k in held:
                out[s] += k / sum(k for _, k in held)
    return out, crossing


@pytest.mark.parametrize("rule", tc.RULES)
def test_spans_equal_brute_force(lib, rule):
    rng = random.Random(5)
    for _ in range(60):
        text = "".join(rng.choice(["a", "the", " ", "\n", "\n\n", "é", "日本", "🙂", "!!"]) for _ in range(rng.randrange(1, 40)))
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, rng.choice([2, 4, 6]))))
        a, b = np.array(cuts[:-1:1]), np.array(cuts[1:])
        if rng.random() < 0.5:  # gaps
            a, b = a[::2], b[::2]
        data = text.encode()
        lengths = np.array([len(lib.decode_single_token_bytes(t)) for t in lib.encode_ordinary(text)])
        count, crossing = tc.allocate(*tc.token_spans(data, lengths), a, b, rule)
        want, across = brute(lib, text, a, b, rule)
        assert np.allclose(count, want) and crossing.tolist() == across


def test_query_totals_and_lines(spark, lib):
    sf = "/root/testdata/sf0.001"
    docs = {d.doc_id: d.text or "" for d in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {}
    for r in tc.op10_token_counts(spark, sf).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == {i for i, t in docs.items() if t}
    for i, rows in got.items():
        rows.sort(key=lambda r: r.section)
        assert sum(r.tokens for r in rows) == len(lib.encode_ordinary(docs[i]))
        assert "".join(docs[i][r.start:r.end] for r in rows) == docs[i] and all(docs[i][r.start:r.end].count("\n") <= 1 for r in rows)
        if len(docs[i]) < 1500:
            a, b = tc.lines(docs[i])
            assert [r.tokens for r in rows] == brute(lib, docs[i], a, b, "most")[0][:-1]


def test_edge_rows(spark, lib):
    rows = [(None, None, "x"), (1, "", "x"), (2, "\n\n\n\n", "x"), (2, "\n\n\n\n", "x"), (None, "one\ntwo", "x"), (3, "é\n" * 20_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, tokens string")
    got = tc.section_tokens(df, "text", PATH, public_tokenizers.PATTERN).collect()
    assert len(got) == 4 + 4 + 2 + 20_000
    assert sum(r.tokens for r in got if r.doc_id == 2) == 2 * len(lib.encode_ordinary("\n\n\n\n"))
    nothing = lambda text: (np.array([0]), np.array([1]))
    gap = tc.section_tokens(df.where("text = 'one\ntwo'"), "text", PATH, public_tokenizers.PATTERN, sections=nothing).collect()
    assert [r.section for r in gap] == [0, -1] and sum(r.tokens for r in gap) == len(lib.encode_ordinary("one\ntwo"))
    assert tc.section_tokens(df.limit(0), "text", PATH, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError):
        tc.section_tokens(df, "text", PATH, public_tokenizers.PATTERN, rule="none")
