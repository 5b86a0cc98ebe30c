"""Each stage against a brute-force version over its own input, the predecessor's result."""

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline as cp
from filingflow.llm.bpe_rank_queue import load_ranks
from filingflow.llm.store import Scratch
from filingflow.llm.suffix_dedup import _whole_characters
from test_latent_decontamination import contains, tokens
from test_near_duplicates import brute as near
from test_suffix_dedup import brute as repeats

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def results(spark):
    scratch, docs = Scratch(spark, "test-pipeline"), spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        docs = scratch.put(stage(spark, docs, SF), name)
        out.append(docs)
    return [(d.columns, d.collect()) for d in out]


def by_id(rows):
    out = {r.doc_id: r for r in rows}
    assert len(out) == len(rows)
    return out


def test_columns(results):
    for columns, _ in results[1:5]:
        assert columns == results[0][0]
    assert set(results[5][0]) == set(results[0][0]) - {"text"} | {"ids", "n_tokens"}


def test_quality(spark, results):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = by_id(results[1][1])
    wrong = [r.doc_id for r in results[0][1] if r.doc_id in labels and (r.doc_id in kept) != (labels[r.doc_id] == 1)]
    assert len(wrong) <= 0.03 * len(labels)
    assert all(kept[i] == r for i, r in by_id(results[0][1]).items() if i in kept)


def test_near_dedup(results):
    component = near([(r.doc_id, r.text) for r in results[1][1]])
    assert by_id(results[2][1]) == {r.doc_id: r for r in results[1][1] if component[r.doc_id] == r.doc_id}


def test_suffix_dedup(results):
    want = {}
    for r, (kept, spans) in zip(results[2][1], repeats([r.text for r in results[2][1]], 200)):
        text = kept.decode("utf-8", "ignore")
        if not spans or text.strip(" \t\n\r\x0b\x0c"):
            want[r.doc_id] = (text, len(text) if spans else r.n_chars, r.lang, r.source)
    assert {r.doc_id: (r.text, r.n_chars, r.lang, r.source) for r in results[3][1]} == want


def test_decontamination(spark, results):
    items = [tokens(b.text) for b in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = by_id(results[4][1])
    for r in results[3][1]:
        words = tokens(r.text)
        held, near_ = set(words), False
        whole = any(set(i) <= held and contains(words, i) for i in items)
        near_ = any(len(set(i) & held) >= 0.6 * len(set(i)) for i in items)
        assert not whole or r.doc_id not in kept
        assert near_ or r.doc_id in kept


def test_tokens(results):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})
    got = by_id(results[5][1])
    assert len(got) == len(results[4][1])
    for r in results[4][1]:
        assert got[r.doc_id].ids == lib.encode_ordinary(r.text) and got[r.doc_id].n_tokens == len(got[r.doc_id].ids)


def test_edge_rows(spark, tmp_path):
    rows = [(None, None, None, None, None), (None, "good words without an id", "en", "s", 3), (1, "", "en", "s", 0), (2, "some words that stay here", None, "s", 5), (2, "some words that stay here", None, "s", 5), (3, "é" * 400, "fr", None, 400)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "an item of the benchmark that nobody has")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = cp.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in out) == [(0, 3), (2, 5)]
    empty = tmp_path / "empty"
    for t, s in (("documents", schema), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], s).write.parquet(str(empty / f"{t}.parquet"))
    assert cp.run(spark, str(empty)).count() == 0


def test_cut_texts_keep_their_own_replacement_characters(spark):
    passage = "é" + "repeated words of a passage " * 12 + "€"
    # spans begin and end within characters: ü and é, ä and ê, € and ₭ share bytes
    rows = [(1, "one \ufffd ü" + passage + "₭ then \ufffd\ufffd"), (2, "two other é" + passage + "\ufffd"), (3, "\ufffd alone"), (4, "\ufffd" + passage + "\ufffd")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = by_id(cp.suffix_array_dedup(spark, docs, SF).collect())
    for (i, text), (kept, spans) in zip(rows, repeats([t for _, t in rows], 200)):
        gone, at, want = [False] * len(text.encode()), 0, ""
        for a, b in spans:
            gone[a:b] = [True] * (b - a)
        for c in text:  # a character stays if all of its bytes do
            n = len(c.encode())
            want, at = want + ("" if any(gone[at:at + n]) else c), at + n
        assert (got[i].text, got[i].n_chars) == (want, len(want))
    assert "\ufffd" in got[1].text and got[3].text == "\ufffd alone"
    text = "a€b é".encode()
    for gone in range(len(text)):
        left = _whole_characters(np.frombuffer(text, np.uint8), np.arange(len(text)) != gone)
        assert bytes(np.frombuffer(text, np.uint8)[left]).decode() in ("€b é", "ab é", "a€ é", "a€bé", "a€b ")


def test_columns_with_clashing_names_come_back(spark, tmp_path):
    clash = ["keep", "quality_score", "evidence", "site_rate", "vertex", "rest", "row", "kept_bytes", "spans", "n_bytes", "text_key", "id", "item_id", "component_id", "kept", "Host.x", "label"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    wide = docs.selectExpr("*", *(f"concat('{c}', doc_id) as `{c}`" for c in clash))
    wide = wide.unionByName(wide.where("doc_id < 20"))
    for (name, stage), lean in zip(cp.STAGES[:4], [docs] * 4):
        out = stage(spark, wide, SF)
        assert out.columns == wide.columns, name
        rows = out.collect()
        assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in clash), name
        assert {r.doc_id for r in rows} <= {r.doc_id for r in lean.select("doc_id").collect()}


def test_a_very_long_text(spark, tmp_path):
    rng = np.random.default_rng(6)
    long = " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 7)) for _ in range(150_000))
    rows = [(1, long), (2, long + " one more"), (3, "few words " * 30 + "é")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in cp.near_dedup(spark, docs, SF).select("doc_id").collect()} == {1, 3}
    assert [len(r.text) for r in cp.suffix_array_dedup(spark, docs.where("doc_id < 3"), SF).orderBy("doc_id").collect()] == [9]  # the first is in the second as a whole
    assert cp.decontamination(spark, docs, SF).count() == 3 and cp.tokens(spark, docs.where("doc_id = 1"), SF).first().n_tokens > 150_000


def test_texts_that_share_an_id_are_judged_one_by_one(spark):
    text = lambda name: " ".join(f"{name}{i}" for i in range(60))
    rows = [(1, text("a")), (2, text("a") + " end"), (2, text("b")), (2, text("b")), (2, text("c")), (3, text("b") + " end"),
            (4, text("d")), (5, None), (5, ""), (5, text("d") + " end"), (None, text("a")), (6, text("e")), (6, text("e") + " end")]
    docs = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in cp.near_dedup(spark, docs, SF).collect()]
    sixth = [t for i, t in got if i == 6]
    assert len(sixth) == 1 and (6, sixth[0]) in rows
    want = [(1, text("a")), (2, text("b")), (2, text("c")), (4, text("d")), (5, None), (5, ""), (None, text("a"))]
    assert sorted((x for x in got if x[0] != 6), key=repr) == sorted(want, key=repr)
