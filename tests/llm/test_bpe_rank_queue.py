import hashlib
import random

import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from filingflow.llm import bpe_rank_queue as bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = bpe.load_ranks(PATH)
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_queues_equal_the_library(reference):
    ranks, lib = reference
    encoder, rng = bpe.Encoder(ranks), random.Random(1)
    for alphabet in (b"aabthein", b"aaab", bytes(range(256))):
        pieces = [bytes(rng.choice(alphabet) for _ in range(rng.choice([1, 2, 3, 8, 40, 64]))) for _ in range(400)]
        pieces = [p for p in pieces if p not in ranks]
        ids, offs = encoder.short(pieces)
        for p, a, b in zip(pieces, offs, offs[1:]):
            want = lib._core_bpe.encode_single_piece(p)
            assert ids[a:b].tolist() == want and encoder.long(p) == want


def test_long_pre_tokens(reference):
    ranks, lib = reference
    encoder = bpe.Encoder(ranks)
    for p in (b"a" * 20_000, b"the" * 9_000, b"\x00\xff" * 5_000):
        assert encoder.long(p) == lib._core_bpe.encode_single_piece(p)


def test_rows(spark, reference):
    _, lib = reference
    texts = [None, "", " ", "a", "Hello world's  \n\n end ", "é" * 3000, "x" * 70_000, "Hello world's  \n\n end ", "<|endoftext|>", "\u0085  \x1c 12³ ½"]
    df = spark.createDataFrame([(i // 2 if i else None, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens_x string")
    out = bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH).collect()
    assert len(out) == len(texts)
    for row, t in zip(out, texts):
        assert row.ids == lib.encode_ordinary(t or "") and bytes(row.decoded).decode() == (t or "") and row.n_tokens_x == "n"
    clash = df.select("text", F.lit("x").alias("ids"), F.lit("y").alias("n_tokens"), F.lit(1).alias("decoded"))
    clash = bpe.digests(bpe.decode(bpe.encode(clash, PATH, public_tokenizers.PATTERN), PATH))
    assert clash.columns == ["n_tokens", "ids_sha256", "decoded_sha256"] and clash.count() == len(texts)
    one_pass = bpe.token_digests(df.withColumn("n_tokens", F.lit("y")), PATH, public_tokenizers.PATTERN)
    assert one_pass.columns == ["doc_id", "n_tokens_x", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert [tuple(r)[1:] for r in one_pass.collect()] == [tuple(r)[1:] for r in bpe.digests(bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH)).collect()]
    assert bpe.digests(bpe.decode(bpe.encode(df.limit(0), PATH, public_tokenizers.PATTERN), PATH)).count() == 0


def test_memory_that_is_full_starts_anew(reference, monkeypatch):
    ranks, lib = reference
    monkeypatch.setattr(bpe, "MEMORY_ENTRIES", 5)
    memory, find = bpe.PackedMemory(ranks), regex.compile(public_tokenizers.PATTERN).findall
    for text in ("one twoo threeeee fourrrr", "fivveee sixxx sevveen eigghht", "one twoo ninne", "sixxx ninne one twoo", "a bbbb cccc ddddd eeeee ffff ggggg"):
        memory.learn([find(text)])
        got = b"".join(map(memory.__getitem__, find(text)))
        assert got == b"".join(i.to_bytes(4, "little") for i in lib.encode_ordinary(text))


def test_query(spark, reference):
    _, lib = reference
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in bpe.op9_bpe_rank_queue(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = lib.encode_ordinary(d.text or "")
        r = got[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()
