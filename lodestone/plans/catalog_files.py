"""Queries over files that Spark makes from the documents: PDF and DOCX pages, landed files, headings, bounds of requests."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import fixed
from lodestone.functions import text as T
from lodestone.plans import search
from lodestone.plans.registry import literal, query, table
from lodestone.sources import documents
from lodestone.storage import scratch_path

#: Lines of a page of the PDF files made here.
LINES = 40
#: What XML cannot hold.
_ODD = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"


def _lines() -> Column:
    """The lines of a text that hold more than blanks."""
    return F.filter(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), _ODD + "|\r", ""), "\n"), lambda x: x.rlike(r"[^ \t]"))


_LINES = rf"list_filter(string_split(regexp_replace(coalesce(text, ''), '{_ODD}|\r', '', 'g'), chr(10)), lambda x: regexp_matches(x, '[^ \t]'))"


def _squeezed_sql(text: str) -> str:
    return rf"regexp_replace(regexp_replace({text}, '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')"


def _pdf(lines: list[str]) -> bytes:
    """A PDF of pages of LINES lines; strings are UTF-16 codes, and the font's character map says so."""
    pages = [lines[i : i + LINES] for i in range(0, max(len(lines), 1), LINES)]
    chars = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange"
    bodies = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{' '.join(f'{5 + 2 * i} 0 R' for i in range(len(pages)))}] /Count {len(pages)} >>".encode()]
    bodies += [b"<< /Type /Font /Subtype /Type0 /ToUnicode 4 0 R >>", _stream(chars)]
    for i, page in enumerate(pages):
        shown = "\n".join(f"<{x.encode('utf-16-be', 'replace').hex()}> Tj 0 -14 Td" for x in page)
        bodies += [f"<< /Type /Page /Parent 2 0 R /Contents {6 + 2 * i} 0 R /Resources << /Font << /F1 3 0 R >> >> >>".encode(), _stream(f"BT /F1 12 Tf 72 720 Td\n{shown}\nET".encode())]
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%b\nendobj\n" % (i + 1, b) for i, b in enumerate(bodies)) + b"trailer << /Root 1 0 R >>\n%%EOF"


def _stream(data: bytes) -> bytes:
    packed = zlib.compress(data, 1)
    return b"<< /Length %d /Filter /FlateDecode >>\nstream\n%b\nendstream" % (len(packed), packed)


def _docx(lines: list[str]) -> bytes:
    from xml.sax.saxutils import escape

    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    paras = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in lines)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body>{paras}</w:body></w:document>')
    return out.getvalue()


def _made(spark, sf_dir, suffix: str, make: Callable[[list[str]], bytes]):
    """(path, content): each document as a file of its kind."""

    @F.pandas_udf("binary")
    def packed(lines: pd.Series) -> pd.Series:
        return lines.map(lambda x: make(list(x)))

    return table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(suffix)).alias("path"), packed(_lines()).alias("content"))


_PAGES = f"list_transform(range(0, greatest(len(l), 1), {LINES}), lambda i: {_squeezed_sql(f'array_to_string(list_slice(l, i + 1, i + {LINES}), chr(10))')})"


@query(f"SELECT doc_id::VARCHAR || '.pdf' AS path, len(p) AS pages, md5(array_to_string(p, chr(10) || chr(10))) AS text FROM (SELECT doc_id, {_PAGES} AS p FROM (SELECT doc_id, {_LINES} AS l FROM documents))")
def pdf_files(spark, sf_dir):
    """Every document as a PDF file, read back page by page."""
    read = documents.parse_files(_made(spark, sf_dir, ".pdf", _pdf))
    return read.where("error is null and kind = 'pdf'").select("path", F.size("pages").cast("long").alias("pages"), F.md5("text").alias("text"))


@query(f"SELECT doc_id::VARCHAR || '.docx' AS path, 'docx' AS kind, md5({_squeezed_sql(f'array_to_string({_LINES}, chr(10))')}) AS text FROM documents")
def docx_files(spark, sf_dir):
    return documents.parse_files(_made(spark, sf_dir, ".docx", _docx)).where("error is null").select("path", "kind", F.md5("text").alias("text"))


@query(f"SELECT doc_id::VARCHAR || '.txt' AS name, octet_length(encode(t)) AS size, md5({_squeezed_sql('t')}) AS text FROM (SELECT doc_id, array_to_string({_LINES}, chr(10)) AS t FROM documents)")
def landed_files(spark, sf_dir):
    """Every document fetched from its address (a data URL) into a folder, and the folder read."""
    said, folder = F.array_join(_lines(), "\n"), scratch_path(spark, "landed")
    rows = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.concat(F.lit("data:text/plain;base64,"), F.regexp_replace(F.base64(F.encode(said, "utf-8")), r"\s", "")).alias("url"))
    read = documents.read_landed(documents.land_files(rows, folder), folder)
    return read.select("name", "size", F.when(F.col("error").isNull(), F.md5("text")).alias("text"))


_HEADED = "replace(coalesce(text, ''), '. ', '.' || chr(10) || 'SECTION 4. ')"
_HEADERS = rf"list_transform(regexp_extract_all({_HEADED}, {literal(fixed.SECTION)}), lambda h: regexp_replace(h, '^\s+|\s+$', '', 'g'))"


@query(f"SELECT doc_id, len(h) AS n, md5(array_to_string(h, '|')) AS headers FROM (SELECT doc_id, {_HEADERS} AS h FROM documents)")
def section_headers(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", T.section_headers(F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(".\nSECTION 4. "))).alias("h"))
    return rows.select("doc_id", F.size("h").cast("long").alias("n"), F.md5(F.array_join("h", "|")).alias("headers"))


@query("""SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN n < 3 OR n > 1000 THEN 'query' END, CASE WHEN k < 1 OR k > 20 THEN 'top_k' END], lambda x: x IS NOT NULL), ',') AS refused
FROM (SELECT conv_id, turn, length(coalesce(text, '')) AS n, (conv_id % 24)::BIGINT AS k FROM conversations)""")
def request_bounds(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("query"), (F.col("conv_id") % 24).alias("top_k"))
    return search.refused(rows).select("conv_id", "turn", F.array_join("refused", ",").alias("refused"))
