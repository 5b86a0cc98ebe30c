import random
import re
from collections import defaultdict

import pytest

from filingflow.llm import license_diagonals as ld


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _brute(text, templates, percent=75):
    """Spans of one text, by loops."""
    w = _words(text)
    verified = []
    for number, (label, notice) in enumerate(templates):
        m = _words(notice)
        by_diagonal = defaultdict(set)
        for p in range(len(w) - 2):
            for t in range(len(m) - 2):
                if w[p:p + 3] == m[t:t + 3]:
                    by_diagonal[p - t].add(t)
        reach = 12 if len(m) >= 16 else 4
        merged = defaultdict(list)
        for d, ts in by_diagonal.items():
            near = [(len(by_diagonal[e]), -e) for e in by_diagonal if abs(d - e) <= reach]
            merged[-max(near)[1]] += [(t, t + d) for t in ts]
        for hits in merged.values():
            covered = min(len({x[k] + o for x in hits for o in range(3)}) for k in (0, 1))
            a, b = min(p for _, p in hits), max(p for _, p in hits) + 3
            if 100 * covered >= percent * max(len(m), b - a):
                verified.append((covered / max(len(m), b - a), len(m), -number, label, a, b))
    kept = set()
    for v in verified:
        won = sum(v[:3] == max(x[:3] for x in verified if x[4] <= i < x[5]) for i in range(v[4], v[5]))
        if 2 * won >= v[5] - v[4]:
            kept.add((-v[2], v[3], v[4], v[5], v[0]))
    return kept


def _texts():
    rng = random.Random(3)
    notices = [t for _, t in ld.TEMPLATES]
    filler = "the of license software under this work lorem ipsum dolor 2 0 version cc by nc".split()
    for _ in range(60):
        out = []
        for _ in range(rng.randrange(1, 6)):
            out += rng.choices(filler, k=rng.randrange(12))
            notice = rng.choice(notices).split()
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(notice))
                notice[at:at + rng.randrange(2)] = rng.choices(filler, k=rng.randrange(3))
            out += notice
        yield " ".join(out)
    yield "Released under the MIT License. " * 40
    yield "under the mit license the mit license under the mit"
    yield "Licensed under CC BY-NC 4.0.\nLicensed under the GNU General Public License, version 3."


def test_spans_equal_brute_force(spark):
    texts = list(_texts())
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = defaultdict(set)
    for r in ld.license_spans(df, "doc_id", "text", ld.license_templates(spark)).collect():
        got[r.id].add((r.template, r.label, r.first_word, r.after, r.score))
    assert {i: got[i] for i in range(len(texts))} == {i: _brute(t, ld.TEMPLATES) for i, t in enumerate(texts)}
    assert sum(map(len, got.values())) > 100


def test_broadcast_or_not_is_the_same(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(_texts())), "doc_id long, text string")
    wide = {tuple(r) for r in ld.license_spans(df, "doc_id", "text", ld.license_templates(spark)).collect()}
    monkeypatch.setattr(ld, "MAX_BROADCAST_WORDS", 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert {tuple(r) for r in ld.license_spans(df, "doc_id", "text", ld.license_templates(spark)).collect()} == wide
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("text, labels", [
    ("Distributed under the MIT-License.", "mit"),
    ("THIS WORK IS LICENSED UNDER THE GNU General Public License, version 3.", "gpl,gpl-3.0"),
    ("Permission is hereby granted free of charge to any person (or company) obtaining a copy of this software and its associated documentation files", "mit"),
    ("redistribution in source form", ""), ("the license of the software", ""), ("Ａll rights reserved", ""), ("All-rights_reserved!", "reserved"), ("all rightsreserved", ""),
])
def test_labels(spark, text, labels):
    df = spark.createDataFrame([(1, f"some words before {text}\n and after it")], "doc_id long, text string")
    row = ld.license_scan(df, "doc_id", "text", ld.license_templates(spark)).first()
    assert row.labels == labels and (row.score > 0) == bool(labels) and 0 <= row.score <= 1


def test_phrase_places_and_edge_rows(spark):
    long = "cc by " + "word é " * 200_000 + "CC-BY general public license"
    rows = [(None, "cc by x"), (None, "cc by x"), (None, None), (1, ""), (2, " .,"), (3, "a"), (3, "a b"), (4, "cc cc by by"), (4, "cc cc by by"), (5, long), (6, "x cc by All rights reserved, cc/by")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, labels string, words string")
    out = ld.license_scan(df, "doc_id", "text", ld.license_templates(spark))
    assert out.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    want = [(None, 3, 1, 0, 0, "cc-by", 1.0), (None, 3, 1, 0, 0, "cc-by", 1.0), (None, 0, 0, None, None, "", 0.0), (1, 0, 0, None, None, "", 0.0), (2, 0, 0, None, None, "", 0.0), (3, 1, 0, None, None, "", 0.0),
            (3, 2, 0, None, None, "", 0.0), (4, 4, 1, 1, 1, "cc-by", 1.0), (4, 4, 1, 1, 1, "cc-by", 1.0), (5, 400_007, 3, 0, 400_004, "cc-by,gpl", 1.0), (6, 8, 3, 1, 6, "cc-by,reserved", 1.0)]
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.score) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert ld.license_scan(df.limit(0), "doc_id", "text", ld.license_templates(spark)).count() == 0
    none = ld.license_templates(spark).limit(0)
    assert {r.labels for r in ld.license_scan(df.where("doc_id = 4"), "doc_id", "text", none).collect()} == {"cc-by"}


def test_main_path_is_native(spark):
    plan = ld.op11_license_diagonals(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Python|Arrow|Pandas|ExistingRDD|CartesianProduct|NestedLoop", plan)
