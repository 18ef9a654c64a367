"""ZIP archives of statute pages: entries are listed first, then read one by one, so many tasks share a large archive."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.documents import _Text

#: Entries in a task's range; a range opens its archive once.
ENTRIES = 256


def _opened(path: str):
    from pyarrow.fs import FileSystem

    fs, inner = FileSystem.from_uri(re.sub("^file:/+", "/", path))
    f = fs.open_input_file(inner)
    if f.size() >= 1 << 16:
        return f
    with f:  # small ones whole: an empty archive is shorter than what zipfile seeks back over
        return io.BytesIO(f.read())


def archive_paths(spark: SparkSession, path: str, glob: str = "*.zip") -> DataFrame:
    """(path) of the archives in a folder; their content is not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path")


def entries(paths: DataFrame) -> DataFrame:
    """paths (path) -> (path, name, size, part, error): a row for each file of each archive, from its directory alone.

    An archive that cannot be opened is one row with its error. A null path gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    with _opened(path) as f, zipfile.ZipFile(f) as z:
                        found = [(path, i.filename, i.file_size, k // ENTRIES, None) for k, i in enumerate(x for x in z.infolist() if not x.is_dir())]
                except Exception as e:  # noqa: BLE001  the reason is kept with the archive
                    found = [(path, None, None, 0, f"{type(e).__name__}: {e}")]
                for k in range(0, len(found), 10_000):
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in found[k : k + 10_000]], schema=schema)

    schema = pa.schema([("path", pa.string()), ("name", pa.string()), ("size", pa.int64()), ("part", pa.int64()), ("error", pa.string())])
    return paths.select("path").where("path is not null").mapInArrow(run, "path string, name string, size long, part long, error string")


def read_entries(found: DataFrame) -> DataFrame:
    """Entries (path, name, part, error) -> (path, name, content binary, error); the entries of a range go to one task.

    The number of tasks is that of the session's shuffles: by the size of their names all entries would be put into one.
    An entry that cannot be read has an error and no content. Names that an archive holds twice give the last one's content.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, f, z = None, None, None
        try:
            for batch in batches:
                for path, name, error in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    content = None
                    if error is None:
                        try:
                            if path != at:
                                if z is not None:
                                    z.close(), f.close()
                                at, z = None, None
                                f = _opened(path)
                                z = zipfile.ZipFile(f)
                                at = path
                            content = z.read(name)
                        except Exception as e:  # noqa: BLE001  the reason is kept with the entry
                            error = f"{type(e).__name__}: {e}"
                    yield pa.RecordBatch.from_pylist([{"path": path, "name": name, "content": content, "error": error}], schema=schema)
        finally:
            if z is not None:
                z.close(), f.close()

    schema = pa.schema([("path", pa.string()), ("name", pa.string()), ("content", pa.binary()), ("error", pa.string())])
    spread = found.repartition(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path", "part").sortWithinPartitions("path", "part", "name")
    return spread.select("path", "name", "error").mapInArrow(run, "path string, name string, content binary, error string")


class _Section(_Text):
    """Also notes where headings and paragraphs begin and end among the text nodes."""

    def __init__(self) -> None:
        super().__init__()
        self.blocks: list[list] = []

    def handle_starttag(self, tag, attrs):
        super().handle_starttag(tag, attrs)
        if tag in ("h1", "h2", "h3", "h4", "p") and not self.depth:
            self._end(tag)
            self.blocks.append([tag, len(self.parts), None])

    def handle_endtag(self, tag):
        super().handle_endtag(tag)
        self._end(tag)

    def _end(self, tag: str) -> None:
        for block in reversed(self.blocks):  # the last block of a kind is the only one that may be open
            if block[0] == tag:
                block[2] = len(self.parts) if block[2] is None else block[2]
                return

    def first(self, tags: tuple[str, ...], fits) -> str:
        for tag, start, end in self.blocks:
            text = " ".join(self.parts[start:end]) if tag in tags else ""
            if text and fits(text):
                return text
        return ""


def section_of(page: str, name: str) -> tuple[str, str, str]:
    """(citation, catchline, text) of a statute page; the citation is that of a heading, else the file's name without its leading IC.

    IC stands for itself there: a word that ends in it, as in `pathetic 12`, cites nothing.
    """
    p = _Section()
    p.feed(page)
    p.close()
    citation = p.first(("h1", "h2", "h3"), lambda t: re.search(r"\bIC\s+\d+", t, re.IGNORECASE))
    if not citation:
        parts = re.sub(r"\.[^.]*$", "", name.rsplit("/", 1)[-1]).replace("_", "-").split("-")
        parts = parts[1:] if parts[0].upper() == "IC" else parts
        citation = "IC " + "-".join(parts) if len(parts) >= 2 else ""
    return citation, p.first(("h4", "p"), lambda t: not re.match(r"\d", t)), re.sub(r"\s+", " ", " ".join(p.parts)).strip()


def _number(folder: Column) -> Column:
    return F.regexp_replace(folder, "[^0-9.]", "")


def statute_sections(paths: DataFrame, titles: list[str] | None = None, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """Archives (path) of title/article/.../section.html -> (sections, unreadable).

    sections: (path, name, title, article, citation, catchline, text) of the pages of the given titles (None: all);
    pages with less than `least` characters drop out. Titles are compared before anything is unpacked. unreadable: (path,
    name, error) of archives and entries that cannot be read. Both parts read the archives: write what is used twice.
    """
    folders = F.split(F.regexp_replace("name", r"\\", "/"), "/")
    title = _number(F.get(folders, F.lit(0)))
    listed = entries(paths)
    wanted = listed.where(F.col("error").isNotNull() | F.col("name").endswith(".html") & (F.lit(True) if not titles else title.isin(titles)))
    pages = read_entries(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                citation, catchline, text = section_of(content.decode("utf-8", "replace"), name)
                yield pa.RecordBatch.from_pylist([{"path": path, "name": name, "citation": citation, "catchline": catchline, "text": text}], schema=schema)

    schema = pa.schema([(n, pa.string()) for n in ("path", "name", "citation", "catchline", "text")])
    read = pages.where("error is null").select("path", "name", "content").mapInArrow(run, "path string, name string, citation string, catchline string, text string")
    article = F.coalesce(F.nullif(_number(F.get(folders, F.lit(1))), F.lit("")), F.lit("0"))
    sections = read.where(F.char_length("text") >= least).select("path", "name", title.alias("title"), article.alias("article"), "citation", "catchline", "text")
    return sections, pages.where("error is not null").select("path", "name", "error")
