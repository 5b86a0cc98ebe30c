"""PDF stage with an injected extractor (SRC-7, FLT-7, UD-6, AG-3)."""

from filingflow.plans import pdf_text


def test_pdf_text(spark, tmp_path):
    # defined inside the test so it is shipped to the Python workers by value
    def fake_extractor(b: bytes):
        body = b[len(b"%PDF"):].decode()
        if body.startswith("!"):
            raise ValueError("corrupt")
        return body.split("|")

    (tmp_path / "a.pdf").write_bytes(b"%PDFpage one||page three")
    (tmp_path / "b.pdf").write_bytes(b"PDF not really")
    (tmp_path / "c.pdf").write_bytes(b"%PDF!broken")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    texts, rejects = pdf_text.extract(spark, str(tmp_path), fake_extractor)
    got = {r["path"].rsplit("/", 1)[-1]: r["text"] for r in texts.collect()}
    assert got == {"a.pdf": "page one\npage three\n", "d.pdf": ""}
    rej = {r["path"].rsplit("/", 1)[-1]: r["reject_reason"] for r in rejects.collect()}
    assert rej["b.pdf"].startswith("not a PDF") and "corrupt" in rej["c.pdf"]


def test_html_files_with_charset_fallback(spark, tmp_path):
    from filingflow.sources import documents
    d = tmp_path / "0000000001" / "000000000122000004"
    d.mkdir(parents=True)
    (d / "d.htm").write_bytes(b"<p>caf\xe9</p>")
    got = documents.keyed_by_archive_path(documents.read_html_files(spark, str(tmp_path)), str(tmp_path)).first()
    assert got["html"] == "<p>café</p>"
    assert got["url"].endswith("/0000000001/000000000122000004/d.htm")
