import zlib

import numpy as np

from filingflow.llm import language_id as lid

SF = "/root/testdata/sf0.01"


def test_query_learns_languages(spark):
    rows = lid.op3_language_id(spark, SF).collect()
    docs = {d.doc_id: d for d in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    right = total = 0
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        if r.held_out and docs[r.doc_id].lang:
            total += 1
            right += r.lang_pred == docs[r.doc_id].lang
    assert right / total > 0.97


def test_counts_equal_brute_force(spark):
    texts = [("Ab c", "x"), ("é!é", "y"), (None, "x"), ("12 !", "y"), ("ab", None), ("Ab c", "x")]
    model = lid.fit(spark.createDataFrame(texts, "text string, lang string"), "text", "lang")
    features = lid.Features()

    def grams(text):
        s = "".join(c.lower() if c.isalpha() else " " for c in text)
        return [s[i:i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1) if s[i:i + n].strip()]

    def bucket(gram):
        raw = np.frombuffer(("zz" + gram).encode(), np.uint8)
        has, at, found = features.of(np.frombuffer(gram.encode(), np.uint8), np.array([0, len(gram.encode())]))
        position, b = found[len(gram) - 1]
        assert len(raw) and position[0] == 0
        return int(b[0])

    assert model.labels == ["x", "y"]
    for label, text, times in (("x", "Ab c", 2), ("y", "é!é", 1)):
        counts = np.zeros(lid.BUCKETS)
        for g in grams(text):
            counts[bucket(g)] += times
        want = np.log(counts + lid.SMOOTHING) - np.log(counts.sum() + lid.SMOOTHING * lid.BUCKETS)
        assert np.allclose(model.log_probability[model.labels.index(label)], want)


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, "", "a"), (None, "123 \n", "a"), (2, "hello there", "a"), (2, "hello there", "a"), (3, "ж" * 100_000, None)], "doc_id long, text string, label string")
    train = spark.createDataFrame([("hello you", "en"), ("где ж", "ru")], "text string, lang string")
    out = lid.predict(df, lid.fit(train, "text", "lang"), "text").collect()
    assert [r.lang_pred for r in out] == ["und", "und", "und", "en", "en", "ru"]
    assert [r.score for r in out][:3] == [0, 0, 0] and out[0].label == "a"
    none = lid.fit(train.limit(0), "text", "lang")
    assert {r.lang_pred for r in lid.predict(df, none, "text").collect()} == {"und"}
    assert lid.predict(df.limit(0), none, "text").count() == 0
