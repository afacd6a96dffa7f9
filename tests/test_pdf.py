"""PDF pages: files written here byte by byte, read through Spark."""

import zlib

import pytest

from folioscope.sources import files, pdf


def written_pdf(pages, packed=True, unicode=False, order=None):
    """A file of pages, each a list of lines."""
    objs = {1: b"<< /Type /Catalog /Pages 2 0 R >>"}
    kids = order or list(range(len(pages)))
    objs[2] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(pages), b" ".join(b"%d 0 R" % (10 + 2 * k) for k in kids))
    font = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica" + (b" /ToUnicode 5 0 R" if unicode else b"") + b" >>"
    objs[4] = font
    if unicode:
        table = b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfchar <0001> <00e9> endbfchar 1 beginbfrange <0041> <005a> <0041> endbfrange"
        objs[5] = b"<< /Length %d >>\nstream\n%s\nendstream" % (len(table), table)
    for k, lines in enumerate(pages):
        shown = b"BT /F1 12 Tf 72 700 Td " + b" 0 -14 Td ".join(lines) + b" ET"
        body = zlib.compress(shown) if packed else shown
        objs[10 + 2 * k] = b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 4 0 R >> >> /Contents %d 0 R >>" % (11 + 2 * k)
        objs[11 + 2 * k] = b"<< /Length %d %s>>\nstream\n%s\nendstream" % (len(body), b"/Filter /FlateDecode " if packed else b"", body)
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in objs.items()) + b"trailer << /Root 1 0 R >>\n%%EOF"


@pytest.mark.parametrize("packed", [True, False])
def test_pages_by_their_operators(packed):
    data = written_pdf([[b"(Hello \\(world\\)\\041) Tj", b"[(Sp) -20 (lit) -300 (word)] TJ"], [b"<53656320> Tj (ond) Tj", b"(caf\\351) Tj"]], packed)
    assert pdf.pages(data) == ["Hello (world)!\nSplit word", "Sec ond\ncafé"]
    assert pdf.pages(written_pdf([[b"(a) Tj"], [b"(b) Tj"], [b"(c) Tj"]], packed, order=[2, 0, 1])) == ["c", "a", "b"]
    assert pdf.pages(written_pdf([[b"<00410001004200430001> Tj"]], packed, unicode=True)) == ["AéBCé"]


def test_objects_in_object_streams():
    inner = [(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [3 0 R] >>"), (3, b"<< /Type /Page /Contents 9 0 R >>")]
    head, body = b"", b""
    for n, b in inner:
        head += b"%d %d " % (n, len(body))
        body += b + b" "
    flat = zlib.compress(head + body)
    page = b"BT (packed away) Tj ET"
    data = b"%%PDF-1.5\n8 0 obj\n<< /Type /ObjStm /N 3 /First %d /Filter /FlateDecode >>\nstream\n%s\nendstream\nendobj\n9 0 obj\n<< >>\nstream\n%s\nendstream\nendobj\n" % (len(head), flat, page)
    assert pdf.pages(data) == ["packed away"]


def test_a_folder_of_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(written_pdf([[b"(one) Tj"], [b"(two) Tj"]]))
    (tmp_path / "b.PDF").write_bytes(b"no such file")
    (tmp_path / "c.txt").write_text("plain")
    (tmp_path / "d.exe").write_text("unknown")
    own = files.binary_files(spark, str(tmp_path))
    got = {(r.path.rsplit("/", 1)[1], r.page, r.text) for r in pdf.pdf_pages(own).collect()}
    assert got == {("a.pdf", 1, "one"), ("a.pdf", 2, "two"), ("b.PDF", 1, None)}
    assert {r.path.rsplit("/", 1)[1] for r in own.collect()} == {"a.pdf", "b.PDF", "c.txt"} and len(files.LIMITS) == 11
