import random
import re

import numpy as np

from filingflow.llm import latent_decontamination as ld


def tokens(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def contains(words, item):
    return any(words[i:i + len(item)] == item for i in range(len(words) - len(item) + 1))


def test_query_finds_whole_items_and_no_others(spark):
    for sf in ("sf0.01", "sf0.1"):
        sf = f"/root/testdata/{sf}"
        docs = {d.doc_id: tokens(d.text) for d in spark.read.parquet(f"{sf}/documents.parquet").collect()}
        items = {b.item_id: tokens(b.text) for b in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
        got = {(r.doc_id, r.item_id): r for r in ld.op5_latent_decontamination(spark, sf).collect()}
        sets = {i: set(w) for i, w in docs.items()}
        want = {(d, b) for b, item in items.items() for d, words in docs.items() if set(item) <= sets[d] and contains(words, item)}
        assert want and want <= set(got)
        for d, b in set(got) - want:  # anything else must be a near copy
            assert len(set(items[b]) & sets[d]) >= 0.6 * len(set(items[b]))


def test_paraphrases_and_decoys(spark):
    rng = random.Random(2)
    common = [f"c{i}" for i in range(30)]
    rare = [f"rare{i}" for i in range(4000)]
    text = lambda n: [rng.choice(rare if rng.random() < 0.5 else common) for _ in range(n)]
    bench = [(i, " ".join(text(30)) + ". Answer: " + " ".join(rng.sample(rare, 3))) for i in range(20)] + [(50, " ".join(text(150))), (60, "too short"), (None, " ".join(text(30))), (70, None)]
    words = {i: (t or "").replace(".", "").split() for i, t in bench if i is not None}
    docs, want = [(900, None), (901, ""), (None, " ".join(words[0])), (902, "c1 " * 30_000)], set()
    for i in range(20):
        w = list(words[i])
        # other words, the answer whole; at most a third of the twelve terms go
        for k in rng.sample([k for k in range(30) if w[k] in rare], 4) + rng.sample([k for k in range(30) if w[k] in common], 4):
            w[k] = "other"
        docs += [(i, " ".join(text(200) + words[i] + text(100))), (100 + i, " ".join(text(77) + w + text(40))), (200 + i, " ".join(text(60) + words[i][:8] + text(60)))]
        want |= {(i, i), (100 + i, i)}
    docs += [(300, " ".join(text(40) + words[50] + text(40))), (300, " ".join(text(40) + words[50] + text(40)))]
    want.add((300, 50))
    got = ld.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), "doc_id", "text").collect()
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})
    assert {(r.doc_id, r.item_id) for r in got} == want


def test_blocks_and_empty_tables(spark, monkeypatch):
    rng = random.Random(5)
    bench = [(i, " ".join(f"w{rng.randrange(900)}" for _ in range(20))) for i in range(7)]
    docs = spark.createDataFrame([(i, "x y z " * 20 + t + " u v" * 30, "a") for i, t in bench], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    monkeypatch.setattr(ld, "PORTION", 3)
    assert {(r.doc_id, r.item_id) for r in ld.leaks(docs, b, "doc_id", "text").collect()} == {(i, i) for i in range(7)}
    assert ld.leaks(docs, b.limit(0), "doc_id", "text").count() == 0
    assert ld.leaks(docs.limit(0), b, "doc_id", "text").count() == 0


def test_common_subsequences_equal_the_table():
    rng = np.random.default_rng(4)
    for _ in range(40):
        a, b = rng.integers(0, 6, rng.integers(1, 65)), rng.integers(-1, 6, rng.integers(1, 80))
        mask = np.zeros((1, 7), np.uint64)
        for k, x in enumerate(a.tolist()):
            mask[0, x] |= np.uint64(1 << k)
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert ld.common_subsequences(mask[:, b], np.bitwise_or.reduce(mask, 1))[0] == table[-1, -1]


def test_sketch_finds_the_singular_vectors():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(400, 5)) @ rng.normal(size=(5, 60))
    omega = rng.normal(size=(60, 12))
    v, size = ld.leading(a.T @ (a @ omega), omega, 48)
    assert v.shape[1] == 5 and np.allclose(a @ v @ v.T, a, atol=1e-6) and np.allclose(size, np.linalg.svd(a)[1][:5])
    v, size = ld.leading(a.T @ (a @ omega), omega, 3)
    assert np.allclose(np.abs(v.T @ np.linalg.svd(a)[2][:3].T), np.eye(3), atol=1e-6)


def test_passages_and_sketch_equal_brute_force():
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(n)) for n in (0, 1, 31, 32, 33, 64, 65, 200)]
    data = [t.encode() for t in texts]
    buf, offs = np.frombuffer(b"".join(data), np.uint8), np.cumsum([0] + [len(d) for d in data])
    lay = ld._Layout(buf, offs)
    vocabulary = np.unique(lay.h)[::2]
    space = ld.Space(vocabulary, np.arange(1.0, len(vocabulary) + 1))
    a, of = [], []
    for t, d in zip(texts, data):
        h = ld.words_of(np.frombuffer(d, np.uint8), np.array([0, len(d)]))[0]
        for k in range(max(-(-len(h) // 32) - 1, min(len(h), 1))):
            a.append([(h[32 * k:32 * k + 64] == x).sum() * w for x, w in zip(vocabulary, space.idf)])
            of.append(t)
    a = np.array(a, float)
    word, t = space.terms(lay.h)
    weighted = space.idf[:, None] * np.eye(len(vocabulary), dtype=np.float32)
    assert np.allclose(lay.passages(lay.half_sums(word, weighted[t])), a) and [texts[i] for i in lay.text] == of
    omega = np.random.default_rng(2).normal(size=(len(vocabulary), 3)).astype(np.float32)

    class Shipped:
        value = space, omega

    import pyarrow as pa
    (out,) = ld._sketch(Shipped)([pa.record_batch({"text": texts})])
    assert np.allclose(np.array(out["g"].to_pylist()), a.T @ (a @ omega), rtol=1e-4) and out["term"].to_pylist() == list(range(len(vocabulary)))
    counts = {h: n for b in ld._counts([pa.record_batch({"text": texts})]) for h, n in zip(b["h"].to_pylist(), b["n"].to_pylist())}
    assert counts.pop(None) == len(np.unique(lay.half)) and counts == {int(h.view(np.int64)): len(set(lay.half[lay.h == h])) for h in np.unique(lay.h)}


def _synonyms(rng):
    """A corpus of topics, whose words come in pairs used alike, and items with paraphrases that use the other word."""
    glue = [f"c{i}" for i in range(40)]
    pairs = {t: [(f"t{t}a{k}", f"t{t}b{k}") for k in range(14)] for t in range(24)}

    def text(t, n):
        return [rng.choice(rng.choice(pairs[t])) if rng.random() < 0.5 else rng.choice(glue) for _ in range(n)]

    docs = [(1000 + i, " ".join(text(i % 24, 300))) for i in range(600)]
    bench, want, decoys = [], set(), set()
    for i in range(48):
        topic = pairs[i % 24]
        rare = rng.sample(topic, 12)
        slots = sorted(rng.sample(range(32), 12))
        item, other = [rng.choice(glue) for _ in range(32)], None
        for slot, (a, _) in zip(slots, rare):
            item[slot] = a
        other = list(item)
        for slot, (_, b) in rng.sample(list(zip(slots, rare)), 9):  # three of twelve stay: a quarter
            other[slot] = b
        answer = [rng.choice(glue) for _ in range(4)]
        bench.append((i, " ".join(item) + ". Answer: " + " ".join(answer)))
        docs.append((i, " ".join(text(i % 24, 90) + other + answer + text(i % 24, 70))))
        want.add((i, i))
        docs.append((100 + i, " ".join(text(i % 24, 90) + rng.sample(other, len(other)) + text(i % 24, 70))))  # the words without their order
        decoys.add(100 + i)
    return docs, bench, want, decoys


def test_paraphrases_are_found_through_the_space_only(spark):
    docs, bench, want, decoys = _synonyms(random.Random(4))
    df, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in ld.leaks(df, b, "doc_id", "text").collect()}
    assert len(want & got) >= 0.9 * len(want) and not {d for d, _ in got} & decoys and len(got - want) <= 2
    # without candidates by cosine only the near copies by chance are left
    assert ld.leaks(df, b, "doc_id", "text", cosine=2.0).count() <= 0.05 * len(want)


def test_near_copies_without_the_rarest_words(spark):
    rng = random.Random(3)
    common = [f"c{i}" for i in range(300)]
    bench, docs, want = [], [], set()
    for i in range(20):  # 64 words, of which the 12 rarest are changed: 81 % are left in order
        w = rng.sample(common, 52)
        for k in range(12):
            w.insert(rng.randrange(len(w)), f"longname{i}x{k}")
        bench.append((i, " ".join(w)))
        for copy, gone in enumerate((range(12), range(5))):
            gone = {f"longname{i}x{k}" for k in gone}
            around = [f"other{rng.randrange(10**6)}" for _ in range(rng.randrange(300))]
            docs.append((100 * copy + i, " ".join(around + [x if x not in gone else "name" for x in w] + around)))
            want.add((100 * copy + i, i))
    got = ld.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), "doc_id", "text").collect()
    assert {(r.doc_id, r.item_id) for r in got} == want


def test_all_windows_with_most_words_in_order_are_found(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(250)]
    bench = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice((5, 9, 30, 59, 64, 100))))) for i in range(30)]
    parts = ld.parts_of(sorted(bench))
    code = {h: n for n, h in enumerate(np.unique(np.concatenate([p.h for p in parts])).tolist())}
    mask = np.zeros((len(parts), len(code) + 1), np.uint64)
    for i, p in enumerate(parts):
        for k, h in enumerate(p.h.tolist()):
            mask[i, code[h]] |= np.uint64(1 << k)
    docs, want = [], set()
    for d in range(90):
        i, text = rng.choice(bench)
        w, out = text.split(), []
        edits = set(rng.sample(range(len(w)), int(len(w) * rng.uniform(0.1, 0.3))))
        for k, x in enumerate(w):  # changed, left out, or with words put between
            out += [x] if k not in edits else rng.choice(([rng.choice(vocabulary)], [], [x, "put", "in"]))
        around = lambda: [rng.choice(vocabulary) for _ in range(rng.randrange(150))]
        words = around() + out + around()
        docs.append((d, " ".join(words)))
        data = docs[-1][1].encode()
        h = [code.get(x, -1) for x in ld.words_of(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0].tolist()]
        for k in range(max(-(-len(h) // 32) - 1, 1)):
            found = ld.common_subsequences(mask[:, h[max(0, 32 * k - 64):32 * k + 128]], np.bitwise_or.reduce(mask, 1)) / [len(p.h) for p in parts]
            want |= {(d, p.item_id) for p, x in zip(parts, found) if x >= ld.WHOLE}
    got = ld.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), "doc_id", "text").collect()
    assert len(want) > 30 and want == {(r.doc_id, r.item_id) for r in got if r.words_found >= ld.WHOLE}


def test_places_that_words_fill_equal_a_loop(monkeypatch):
    rng = np.random.default_rng(6)
    monkeypatch.setattr(ld, "_FEW", 7)
    parts = ld.parts_of([(i, " ".join(f"w{k}" for k in rng.integers(0, 40, rng.integers(5, 30)))) for i in range(12)])
    items = ld.Items(parts)
    known = rng.integers(0, len(items.vocabulary), 300)
    part, begin = rng.integers(0, len(parts), 60), rng.integers(0, 300, 60)
    end = np.minimum(300, begin + rng.integers(0, 25, 60))
    want = [sum(1 << k for k, h in enumerate(parts[p].h) if h in items.vocabulary[known[a:b]]) for p, a, b in zip(part, begin, end)]
    assert want == items.there(part, begin, end, known).tolist()
    items.table = None
    assert want == items.there(part, begin, end, known).tolist()
    assert items.there(part[:0], begin[:0], end[:0], known).tolist() == []


def test_sums_by_half_take_rows_by_number():
    rng = np.random.default_rng(7)
    texts = [b" ".join(b"w%d" % k for k in rng.integers(0, 50, n)) for n in (0, 1, 31, 32, 33, 200)]
    lay = ld._Layout(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts]))
    word = np.flatnonzero(rng.random(len(lay.h)) < 0.6)
    table, number = rng.normal(size=(9, 4)), rng.integers(0, 9, len(word))
    want = np.zeros((int(lay.halves.sum()), 4))
    np.add.at(want, lay.half[word], table[number])
    assert np.allclose(lay.half_sums(word, table, number), want) and np.allclose(lay.half_sums(word, table[number]), want)
    assert not lay.half_sums(word[:0], table, number[:0]).any()
