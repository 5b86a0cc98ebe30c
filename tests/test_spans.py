"""Windows over word spans: places, whole texts, cases without words."""

from hypothesis import given, settings
from hypothesis import strategies as st

from filingflow.functions.spans import window_spans
from filingflow.operators import chunking


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \t\n\x0b é😀", max_size=80), st.integers(2, 6), st.data())
def test_windows_hold_their_words_and_join_to_the_text(text, size, data):
    overlap = data.draw(st.integers(1, size - 1))
    got = window_spans(text, size, overlap)
    words = [w for w in "".join(" " if c in " \t\n\x0b\f\r" else c for c in text).split(" ") if w]
    want, at = [], 0
    while words and (at == 0 or at < len(words) - overlap):
        want.append(words[at:at + size])
        at += size - overlap
    assert [[w for w in "".join(" " if c in " \t\n\x0b\f\r" else c for c in x["chunk_text"]).split(" ") if w] for x in got] == want
    assert all(text[x["char_start"]:x["char_end"]] == x["chunk_text"] for x in got)
    if got:
        starts = [x["char_start"] for x in got[1:]] + [got[-1]["char_end"]]
        joined = "".join(text[x["char_start"]:e] for x, e in zip(got, starts))
        assert joined == text.strip(" \t\n\x0b\f\r")
        assert [x["n_tokens"] for x in got] == [len(w) for w in want]


def test_nulls_empty_and_long_texts(spark):
    long = "word  " * 200_000
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "  one"), (5, long)], "id int, text string")
    rows = chunking.chunk_spans(df, "text", ["id"]).select("id", "chunk_index", "char_start", "char_end").collect()
    assert [tuple(r) for r in rows if r.id < 5] == [(4, 0, 2, 5)]
    of_long = [r for r in rows if r.id == 5]
    assert len(of_long) == chunking_count(200_000) and max(r.char_end for r in of_long) == len(long) - 2


def chunking_count(n):
    return len(range(0, max(1, n - chunking.CHUNK_OVERLAP), chunking.CHUNK_SIZE - chunking.CHUNK_OVERLAP))
