import random
import re

import numpy as np
import pytest

from filingflow.llm import near_duplicates as nd
from filingflow.llm.components import components
from filingflow.llm.store import Scratch

UPPER = {i: i + 32 for i in range(65, 91)}


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, percent=75):
    """Components over all pairs that share a shingle."""
    sets, at, parent = {}, {}, {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, set()).add(shingles(t))
            parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, many in sets.items():
        for s in many:
            for g in s:
                at.setdefault(g, []).append((i, s))
    for group in at.values():
        for i, s in group:
            for j, o in group:
                if i < j and 100 * len(s & o) >= percent * len(s | o):
                    a, b = root(i), root(j)
                    parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in parent}


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = nd.near_duplicates(df, "doc_id", "text").collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (r.component_id == r.doc_id)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(docs)
    got = {r.doc_id: r for r in nd.op8_similarity_sketching(spark, sf).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(shingles(t)), want[i], want[i] == i)


def test_copies_edits_and_edges(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    rows, i = [(None, "a b c d e f"), (None, None), (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE  two"), (6, "one two three"), (7, "x" * 100_000)], 10
    rows += [(8, "same id one two three four five six"), (8, "same id one two three four five six")]
    for base in range(4):
        text = [rng.choice(words) for _ in range(120)]
        for _ in range(25):
            copy = list(text)
            for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 9])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((i, " ".join(copy)))
            i += 1
    check(spark, rows)


def test_large_buckets_with_families(spark, monkeypatch):
    monkeypatch.setattr(nd, "SMALL", 3)
    monkeypatch.setattr(nd, "RARE", 4)
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(9000)}"
    rows, base = [], [word() for _ in range(110)]
    for _ in range(14):
        family = list(base)
        for k in rng.sample(range(110), rng.choice([0, 1, 4, 6])):
            family[k] = word()
        for _ in range(9):
            text = list(family)
            for k in rng.sample(range(110), rng.choice([0, 1, 2, 3, 5])):
                text[k] = word()
            rows.append((len(rows), " ".join(text)))
    check(spark, rows)


def test_empty_table(spark):
    assert nd.near_duplicates(spark.createDataFrame([], "doc_id long, text string, n long"), "doc_id", "text").count() == 0


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(5)
    for size in (1, 3, 60, 2000):
        h = rng.integers(0, 2**63, size * 2, np.uint64)
        both, errors = size - size // 4, []
        a, b = h[:size], np.concatenate([h[:both], h[size:2 * size - both]])
        s = nd.sketches(np.concatenate([a, b]), np.repeat([0, 1], size), 2)
        assert (s != nd._EMPTY).all()
        errors = (s[0] == s[1]).mean() - both / (2 * size - both)
        assert abs(errors) < 0.2


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(300, 299), (299, 300)]
    df = spark.createDataFrame(links, "u long, v long")
    got = {r.u: r.v for r in components(df, Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in range(101, 140)}, 300: 299}
    assert components(df.limit(0), Scratch(spark, "t")).count() == 0
