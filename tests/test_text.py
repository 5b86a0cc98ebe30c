"""Hand-built text cases (FIXTURES C4, C5, C10)."""

import pytest
from pyspark.sql import functions as F

from filingflow.functions import forms, text
from filingflow.operators import chunking, concat


def one(spark, value, expr, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize("html,expected", [
    ("<p>A<!-- x > y --> B</p><script>z</script>", "A B"),
    ("<p>&amp;lt;b&amp;gt;</p>", "<b>"),
    ("<style>p{}</style><noscript>n</noscript><p>x&nbsp;&copy;&middot;y</p>", "x ©·y"),
    ("<title>T</title><b>A</b>B", "T A B"),
    ("", ""),
])
def test_html_to_text(spark, html, expected):
    assert one(spark, html, text.html_to_text) == expected


def test_html_to_text_common_mode(spark):
    assert one(spark, "<p>&amp;lt;b&amp;gt; &copy;</p>", lambda c: text.html_to_text(c, "common")) == "<b> ©"


def test_html_null(spark):
    assert one(spark, None, text.html_to_text) is None


@pytest.mark.parametrize("s,expected", [
    ("Item 5.07 Submission", True),
    ("Item\u00a05.07", True),
    ("item\u2003\u00a05.07.", True),
    ("ITEM5.07", True),
    (None, False),
    ("Item 5.070", False),
    ("Items 5.07", False),
])
def test_item_507(spark, s, expected):
    assert one(spark, s, text.mentions_item_507) is expected


def test_item_507_after_tag_removal(spark):
    assert one(spark, "Item <b>5.07</b>", lambda c: text.mentions_item_507(text.html_to_text(c))) is True


@pytest.mark.parametrize("raw,expected", [
    (bytes([0x63, 0x61, 0x66, 0xE9]), "café"),
    (bytes([0x63, 0x61, 0x66, 0xC3, 0xA9]), "café"),
])
def test_decode_fallback(spark, raw, expected):
    assert one(spark, bytearray(raw), text.decode_bytes, "v binary") == expected


@pytest.mark.parametrize("n,kept", [(499, False), (500, True)])
def test_min_words(spark, n, kept):
    assert one(spark, " ".join(["w"] * n), lambda c: text.has_min_words(c, 500)) is kept


@pytest.mark.parametrize("raw,ok", [(b"%PDF-1.7 rest", True), (b"PDF-1.7", False), (b"", False)])
def test_pdf_magic(spark, raw, ok):
    assert one(spark, bytearray(raw), text.is_pdf, "v binary") is ok


def test_style_attributes(spark):
    got = one(spark, '<p style="a" id=x>style="y"</p><div STYLE=\'b\'>t</div><i style=c>u</i>',
              text.strip_style_attributes)
    assert got == '<p id=x>style="y"</p><div>t</div><i>u</i>'


def test_page_concat(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, ""), (1, 2, None), (1, 3, "b"), (2, 0, "")],
                               "doc int, page int, t string")
    got = {r["doc"]: r["text"] for r in concat.page_concat(df, ["doc"], "page", "t").collect()}
    assert got == {1: "a\nb\n", 2: ""}


@pytest.mark.parametrize("n,chunks", [(0, 0), (1, 1), (800, 1), (801, 2), (1400, 2), (1401, 3)])
def test_window_counts(spark, n, chunks):
    df = spark.createDataFrame([(1, " ".join(f"t{i}" for i in range(n)))], "id int, text string")
    ch = chunking.chunk_text(df, "text", ["id"])
    assert ch.count() == chunks
    assert chunking.chunk_counts(df, "text", ["id"]).first()["n_chunks"] == chunks
    if chunks:
        rows = sorted(ch.collect(), key=lambda r: r["chunk_index"])
        assert rows[0]["chunk_text"].split()[0] == "t0"
        assert rows[-1]["chunk_text"].split()[-1] == f"t{n - 1}"
        for a, b in zip(rows, rows[1:]):
            assert a["chunk_text"].split()[600:] == b["chunk_text"].split()[:200]


def expected_starts(n, size=800, overlap=200):
    """Declarative rule: a multiple of the stride below n starts a window when
    it is the first one or the previous window stops short of the end."""
    stride = size - overlap
    return [s for s in range(0, n, stride) if s == 0 or s - stride + size < n]


def test_window_formula_matches_rule(spark):
    ns = list(range(0, 2500, 7)) + [599, 600, 601, 799, 800, 801, 1399, 1400, 1401, 2000, 2001]
    df = spark.createDataFrame([(n,) for n in ns], "n int")
    got = df.select("n", chunking.window_starts(F.col("n")).alias("s")).collect()
    for r in got:
        assert expected_starts(r["n"]) == list(r["s"]), r["n"]


def test_window_args_checked():
    with pytest.raises(ValueError):
        chunking.window_starts(F.lit(5), 100, 100)


@pytest.mark.parametrize("form,cls,rev", [
    ("DEF 14A", "proxy_statement", "original"), ("DEFR14A", "proxy_statement", "revision"),
    ("DEFA14A", "proxy_supplement", "supplement"), ("DEFC14A", "contestant_proxy", "original"),
    ("PREC14A", "contestant_proxy", "original"), ("PRRN14A", "contestant_proxy", "original"),
    ("10-K", "other", "other"),
])
def test_form_class(spark, form, cls, rev):
    r = one(spark, form, forms.form_class)
    assert (r["doc_class"], r["revision"]) == (cls, rev)


@pytest.mark.parametrize("form,is8k,isproxy", [
    ("8-K", True, False), ("8-K/A", True, False), ("8-k12b", True, False), (None, False, False),
    ("DEF 14A", False, True), ("defr14a", False, True), ("DEFA14A", False, False), ("DEF 14AX", False, False),
])
def test_form_predicates(spark, form, is8k, isproxy):
    assert one(spark, form, forms.form_matches) is is8k
    assert one(spark, form, forms.is_proxy_statement) is isproxy


@pytest.mark.parametrize("html", [
    "<p>&amp;lt;b&amp;gt; &copy; &nbsp;x</p>",          # native list only
    "<p>caf&eacute; &#233; &#xE9; &amp x &ampere;</p>",  # needs the Python pass
    "<p>&amp;amp;lt; &amp;copy;</p>",                   # double decoding order
    "<p>plain</p>", None,
])
def test_clean_text_matches_exact_unescape(spark, html):
    df = spark.createDataFrame([(1, html)], "id int, html string")
    hybrid = text.add_clean_text(df, "html").first()["text"]
    exact = df.select(text.html_to_text("html").alias("t")).first()["t"]
    assert hybrid == exact


@pytest.mark.parametrize("html,expected", [
    ("<p>a < b and c > d</p>", "a < b and c > d"),
    ("<p>kept</p><script>var x = 1; // truncated", "kept"),
    ("<!DOCTYPE html><?xml x?><p>t</p>", "t"),
])
def test_html_parser_like_edges(spark, html, expected):
    assert one(spark, html, text.html_to_text) == expected


def test_page_concat_across_blocks(spark):
    import random
    pages = [(7, p, "" if p % 10 == 3 else f"p{p}") for p in range(150)]
    random.Random(5).shuffle(pages)
    df = spark.createDataFrame(pages, "doc int, page int, t string")
    got = concat.page_concat(df, ["doc"], "page", "t", block_pages=16).first()["text"]
    assert got == "".join(f"p{p}\n" for p in range(150) if p % 10 != 3)


def test_every_page_is_decoded_from_its_own_bytes(spark, tmp_path):
    from filingflow.plans import catalog
    pages = [(i, f"<p>caf\u00e9 \u20ac {i}</p>") for i in range(7)] + [(7, None)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    rows = catalog.queries()["decode_page_bytes"](spark, str(tmp_path)).collect()
    assert len(rows) == 2 * len(pages)
    assert {(r.page_id, r.text) for r in rows if r.variant == "utf-8"} == set(pages)
    assert {(r.page_id, r.text) for r in rows if r.variant == "windows-1252"} == {(i, f"caf\u00e9 \u20ac {i}") for i, _ in pages}


def test_every_page_takes_both_ways_of_decoding(spark, tmp_path):
    from filingflow.plans.queries_text import decode_html_bytes
    pages = [(1, "a"), (2, "b\u00fc\u20ac\u00cd"), (3, ""), (6, None), (9, "d" * 2000)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    rows = {r.page_id: (r.text, r.text_1252) for r in decode_html_bytes(spark, str(tmp_path)).collect()}
    assert rows == {i: (h, f"caf\u00e9 \u20ac {i} " + (h or "").encode().decode("windows-1252", "replace")) for i, h in pages}
