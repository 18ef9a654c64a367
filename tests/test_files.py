"""PDF pages, landed files, section headers, bounds of requests."""

import base64
import zlib

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.plans import search
from lodestone.sources import documents
from lodestone.sources.pdf import pages_text


def pdf(*bodies, first=1):
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%b\nendobj\n" % (i, b) for i, b in enumerate(bodies, first)) + b"startxref\n99999\n%%EOF"


def stream(data, head=b""):
    return b"<< /Length %d %b >>\nstream\n%b\nendstream" % (len(data), head, data)


def flate(data, head=b""):
    return stream(zlib.compress(data), b"/Filter /FlateDecode " + head)


CATALOG = b"<< /Type /Catalog /Pages 2 0 R >>"
ONE = b"<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources << /Font << /F1 5 0 R >> >> >>"
PAGE = b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>"
PLAIN = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"


def one_page(content, font=PLAIN, *more):
    return pdf(CATALOG, ONE, PAGE, content, font, *more)


@pytest.mark.parametrize(
    "content, said",
    [
        (b"BT /F1 12 Tf 72 720 Td (one) Tj 0 -14 Td (two) Tj ET", "one\ntwo"),
        (b"BT /F1 12 Tf (a \\(b\\) (c) \\101\\n\\\\) Tj ET", "a (b) (c) A\n\\"),
        (b"BT /F1 9 Tf [(wi) -20 (de) -300 (gap)] TJ ET", "wide gap"),
        (b"BT /F1 9 Tf (a) Tj (b) Tj T* (c) Tj (d) ' ET", "ab\nc\nd"),
        (b"BT 1 0 0 1 72 700 Tm (x) Tj 1 0 0 1 90 700 Tm (y) Tj 1 0 0 1 72 680 Tm (z) Tj ET", "x y\nz"),
        (b"BT <48 65 6C6c 6F> Tj ET % a remark (not shown)\nBT (\\223q\\224) Tj ET", "Hello “q”"),
        (b"q BI /W 1 /H 1 ID \x00(\xff EI Q BT (after) Tj ET", "after"),
        (b"", ""),
    ])
def test_text_of_a_page(content, said):
    assert pages_text(one_page(stream(content))) == [said] == pages_text(one_page(flate(content)))


def test_character_maps():
    chars = b"""/CIDInit begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange
2 beginbfchar <0001> <00660069> <0002> <D83DDE00> endbfchar
2 beginbfrange <0010> <0012> <0041> <0020> <0021> [<0078> <0079007A>] endbfrange endcmap"""
    font = b"<< /Type /Font /Subtype /Type0 /ToUnicode 6 0 R >>"
    content = b"BT /F1 9 Tf <0001 0010 0011 0012 0020 0021 0002 0099> Tj ET"
    assert pages_text(one_page(stream(content), font, flate(chars))) == ["fiABCxyz\U0001f600�"]


def test_objects_in_streams_updates_and_order_of_pages():
    inner = [(3, b"<< /Type /Page /Contents [4 0 R 6 0 R] >>"), (7, b"<< /Type /Pages /Kids [8 0 R 2 0 R] >>"), (8, b"<< /Type /Page /Contents 6 0 R >>")]
    head, body = b"", b""
    for n, b in inner:
        head += b"%d %d " % (n, len(body))
        body += b + b" "
    held = flate(head + body, b"/Type /ObjStm /N 3 /First %d " % len(head))
    data = pdf(CATALOG, b"<< /Type /Pages /Kids [3 0 R 7 0 R] >>", held, stream(b"BT (old) Tj ET"), PLAIN, stream(b"BT (second) Tj ET"), first=1)
    data = data.replace(b"3 0 obj", b"9 0 obj") + pdf(stream(b"BT (first) Tj"), first=4)
    assert pages_text(data) == ["first\nsecond".replace("\n", " "), "second"]  # a page tree that comes back to its root ends


def test_files_that_cannot_be_read_are_rows_with_their_error(spark):
    good = one_page(stream(b"BT (fine) Tj ET"))
    files = {
        "good.pdf": good, "signed": good, "secret.pdf": good + b"trailer << /Encrypt 9 0 R >>", "empty.pdf": b"", "cut.pdf": good[:40], "null.pdf": None,
        "fax.pdf": one_page(stream(b"x", b"/Filter /CCITTFaxDecode ")), "open.pdf": one_page(stream(b"BT (never closed Tj ET"))}
    got = {r.path: r for r in documents.parse_files(spark.createDataFrame(list(files.items()), "path string, content binary")).collect()}
    assert len(got) == len(files) and got["good.pdf"].pages == ["fine"] and got["signed"].kind == "pdf" and got["signed"].text == "fine"
    wrong = {k: r.error for k, r in got.items() if r.error}
    assert set(wrong) == set(files) - {"good.pdf", "signed"} and "encrypted" in wrong["secret.pdf"] and "CCITTFaxDecode" in wrong["fax.pdf"]


def test_landed_files_are_read_by_name(spark, tmp_path):
    rows = [(name, f"data:;base64,{base64.b64encode(body).decode()}") for name, body in {"a.txt": b"one", "b.html": b"<p>two</p>", "c.html": b"%PDF no more", "d.txt": b"", "e.txt": b"gone"}.items()]
    landed = documents.land_files(spark.createDataFrame([*rows, ("../f.txt", "data:,x")], "name string, url string"), f"{tmp_path}/land")
    (tmp_path / "land/files/e.txt").unlink()
    got = {r.name: (r.size, r.kind, r.text, r.error is None) for r in documents.read_landed(landed, f"{tmp_path}/land").collect()}
    assert got.pop("c.html")[1] == "pdf"
    assert got == {"a.txt": (3, "text", "one", True), "b.html": (10, "html", "two", True), "d.txt": (0, "text", "", True), "e.txt": (4, "text", "", False)}


def test_landing(spark, tmp_path):
    def data(b):
        return "data:;base64," + base64.b64encode(b).decode()

    rows = [("a.txt", data(b"one")), ("b.html", data(b"<p>two</p>")), ("../c.txt", data(b"x")), (None, data(b"x")), ("d.txt", "file:///no/such/file"), ("e.txt", None), ("f.txt", data(b""))]
    got = {(r.name, r.size): r.error for r in documents.land_files(spark.createDataFrame(rows, "name string, url string"), f"{tmp_path}/land").collect()}
    assert {k for k, e in got.items() if not e} == {("a.txt", 3), ("b.html", 10), ("f.txt", 0)} and len(got) == len(rows)
    read = {r.path.split("/")[-1]: r.text for r in documents.load_documents(spark, f"{tmp_path}/land/files").collect()}
    assert read == {"a.txt": "one", "b.html": "two"}  # Spark lists no empty files; their rows are those of the landing

    def own(url: str) -> bytes:
        return url.upper().encode()

    assert documents.land_files(spark.createDataFrame([("x", "ab")], "name string, url string"), f"{tmp_path}/own", own).first().size == 2
    assert (tmp_path / "own/files/x").read_bytes() == b"AB"


def test_section_headers_and_bounds(spark):
    rows = spark.createDataFrame([("SECTION 1. Scope\nbody\n2.1. Terms\nIV. End\nnot 3. this",), ("none",), (None,)], "t string")
    assert [r.h for r in rows.select(T.section_headers("t").alias("h")).collect()] == [["SECTION 1. Scope", "2.1. Terms", "IV. End"], [], None]
    asked = [("abc", 1), ("ab", 5), ("x" * 1001, 21), (None, None), ("good", 20), ("good", 0)]
    got = [r.refused for r in search.refused(spark.createDataFrame(asked, "query string, top_k int")).collect()]
    assert got == [[], ["query"], ["query", "top_k"], ["query"], [], ["top_k"]]
    fraud = search.refused(spark.createDataFrame([("x" * 501, 1), ("x" * 500, 1)], "query string, k int").select("query"), top_k=None, chars=(3, 500))
    assert fraud.select(F.size("refused").alias("n")).collect()[0].n == 1 and fraud.collect()[1].refused == []


def test_few_files_are_in_a_batch(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        files = spark.range(0, 1000, 1, 1).selectExpr("concat(id, '.txt') as path", "encode('a  b', 'utf-8') as content")
        assert documents.parse_files(files).where("text = 'a b' and error is null").count() == 1000
        assert int(spark.conf.get(key)) == documents.FILES
        spark.conf.set(key, "7")
        documents.parse_files(files)
        assert spark.conf.get(key) == "7"
    finally:
        spark.conf.set(key, before)
