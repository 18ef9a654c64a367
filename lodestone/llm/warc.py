"""WARC archives as a chunked record table.

A record is rows of (record_id, chunk_no, data): a payload longer than `chunk` bytes becomes
several rows, written as WARC segments (first record, then `continuation` records), so neither
the writer nor the reader holds a record larger than one chunk once it has left its source row.
Digests are carried along: one SHA-1 is fed chunk by chunk, and each row holds its value so far
(`running`), which goes into the segment's header. The reader feeds the chunks of a record, in
order, into one incremental digest and holds it against the header after every chunk, so a damaged
archive makes the job fail at the first chunk that differs.

Archives are plain or gzip files written through Spark's own text writer (record separator CRLF
CRLF), so they commit atomically, survive lost executors and may be in any store Spark can reach.
They are read with the separator CRLF CRLF "WARC/1.0" CRLF, which lets Spark split plain files;
the writer ends a segment in the middle of that sequence should a payload hold it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._common import copies_of, join_checked, written

VERSION = b"WARC/1.0\r\n"
SEPARATOR = "\r\n\r\nWARC/1.0\r\n"
CHUNK = 1 << 20


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def cuts(payload: memoryview, chunk: int) -> Iterator[tuple[int, int]]:
    """Chunk borders: at most `chunk` bytes each, and none holds the separator between records."""
    mark, around, at, n = SEPARATOR.encode(), b"\r\n\r\n", 0, len(payload)
    while True:
        end = min(at + chunk, n)
        hit = b"".join((around, payload[at:end], around)).find(mark)  # as it stands between header and closing
        if hit >= 0:
            end = at + hit + 2
        yield at, end
        at = end
        if at >= n:
            return


def chunk_table(records: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """(record_id, url, record_type, refers_to, row, chunk_no, chunks, data, total, payload_digest, digested, running).

    records: (record_id, url, payload binary, record_type, refers_to). A revisit has one chunk
    without data. digested and running: the payload bytes that the digest has seen up to and with
    the chunk, and its value then. payload_digest, that of the whole payload, is in every row, as
    the first segment's header needs it. row: a number of the source row, which keeps the chunks of
    rows with the same id apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            size = 0
            for k in range(batch.num_rows):
                row = {c: batch.column(i)[k].as_py() for i, c in enumerate(batch.schema.names) if c != "payload"}
                view = memoryview(batch.column("payload")[k].as_buffer() if batch.column("payload")[k].is_valid else b"")
                border = list(cuts(view, chunk))
                running = running_digests(view, border)
                if row["record_type"] == "revisit":
                    border, running = [(0, 0)], running[-1:]
                same = row | {"chunks": len(border), "total": len(view), "payload_digest": running[-1]}
                for no, ((a, b), so_far) in enumerate(zip(border, running, strict=True)):
                    rows.append(same | {"chunk_no": no, "data": bytes(view[a:b]), "digested": b, "running": so_far})
                    size += b - a
                    if size >= 8 * CHUNK:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    kinds = {c: records.schema[c].dataType.simpleString() for c in records.columns}
    kind, refers = kinds["record_id"], kinds["refers_to"]
    schema = pa.schema([
        ("record_id", _arrow(kind)), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", _arrow(refers)), ("row", pa.int64()), ("chunk_no", pa.int32()), ("chunks", pa.int32()),
        ("data", pa.binary()), ("total", pa.int64()), ("payload_digest", pa.string()), ("digested", pa.int64()), ("running", pa.string())])
    ddl = f"record_id {kind}, url string, record_type string, refers_to {refers}, row long, chunk_no int, chunks int, data binary, total long, payload_digest string, digested long, running string"
    source = records.select("record_id", "url", "payload", "record_type", "refers_to", F.monotonically_increasing_id().alias("row"))
    return source.mapInArrow(run, ddl)


def running_digests(payload: memoryview, border: list[tuple[int, int]]) -> list[str]:
    """The value of one SHA-1 after each chunk."""
    sha, out = hashlib.sha1(), []
    for a, b in border:
        sha.update(payload[a:b])
        out.append(base32_sha1(sha.copy().digest()))
    return out


def _arrow(kind: str) -> pa.DataType:
    return pa.int64() if kind == "bigint" else pa.string()


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _only(test: Column, text: Column) -> Column:
    return F.when(test, text).otherwise(F.lit(""))


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("null"))


def _urn(*parts: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), *parts, F.lit(">"))


def record_text(date: str) -> Column:
    """The bytes of one WARC record, without the closing CRLF CRLF that the writer adds."""
    many, later = F.col("chunks") > 1, F.col("chunk_no") > 0
    last, number = F.col("chunk_no") == F.col("chunks") - 1, F.col("chunk_no").cast("string")
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]+", "%20")
    kind = F.when(later, "continuation").otherwise(F.col("record_type"))
    own = F.when(later, _urn(_text("record_id"), F.lit(":"), number)).otherwise(_urn(_text("record_id")))
    head = F.concat(
        F.lit(VERSION.decode()),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", own),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", url),
        _only(F.col("refers_to").isNotNull(), _line("WARC-Refers-To", _urn(_text("refers_to")))),
        _only(F.col("record_type") == "revisit", _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _line("WARC-Payload-Length", F.col("total").cast("string")),
        _only(many, _line("WARC-Segment-Number", (F.col("chunk_no") + 1).cast("string"))),
        _only(many & later, _line("WARC-Segment-Origin-ID", _urn(_text("record_id")))),
        _only(many, _line("Source-Row", F.col("row").cast("string"))),
        _only(many, _line("Running-Digest", F.concat(F.lit("sha1:"), F.col("running")))),
        _only(many & last, _line("WARC-Segment-Total-Length", F.col("total").cast("string"))),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.octet_length("data").cast("string")),
        F.lit("\r\n"))
    return F.concat(head, F.col("data").cast("string"))


def write_warc(chunks: DataFrame, path: str, *, date: str | None = None, compression: str = "gzip") -> None:
    """One archive per task under path. A lost task is written again by the commit protocol.

    date: the WARC-Date of all records, by default the time of the call.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    chunks.select(record_text(date).alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


_READ = "record_id string, url string, record_type string, refers_to string, row long, chunk_no int, segmented boolean, data binary, total long, payload_digest string, running string"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The chunked record table of the archives under path.

    (record_id string, url, record_type, refers_to string, row, chunk_no, segmented, data, total,
    payload_digest, running). A record in one chunk is digested here, and a stored payload that
    differs from its header's digest fails; the others are digested by `digests`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [r for x in batch.column(0) if (r := _parsed(x.as_buffer()))]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([
        ("record_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("row", pa.int64()), ("chunk_no", pa.int32()), ("segmented", pa.bool_()),
        ("data", pa.binary()), ("total", pa.int64()), ("payload_digest", pa.string()), ("running", pa.string())])
    raw = spark.read.option("lineSep", SEPARATOR).text(path).select(F.col("value").cast("binary").alias("value"))
    return raw.mapInArrow(run, _READ)


def _head_end(view: memoryview) -> int:
    end = bytes(view[:8192]).find(b"\r\n\r\n")
    return end if end >= 0 or len(view) <= 8192 else bytes(view).find(b"\r\n\r\n")


def _parsed(raw: pa.Buffer) -> dict | None:
    view = memoryview(raw)
    end = _head_end(view)
    if end < 0:
        return None
    fields = {}
    for row in bytes(view[:end]).decode("utf-8", "replace").split("\r\n"):
        name, _, value = row.partition(": ")
        fields[name.lower()] = value
    size = int(fields.get("content-length", 0))
    data = bytes(view[end + 4 : end + 4 + size])
    if len(data) != size:
        raise ValueError(f"record {fields.get('warc-record-id')}: {len(data)} of {size} bytes")

    def ident(name: str) -> str | None:
        return fields[name].removeprefix("<urn:record:").removesuffix(">") if name in fields else None

    def sha(name: str) -> str | None:
        return fields[name].removeprefix("sha1:") if fields.get(name, "").startswith("sha1:") else None

    segmented, kind = "warc-segment-number" in fields, fields.get("warc-type", "")
    running = sha("running-digest")
    if kind != "revisit" and not segmented:
        running = base32_sha1(hashlib.sha1(data).digest())
        if sha("warc-payload-digest") not in (None, running):
            raise ValueError(f"record {ident('warc-record-id')}: the payload differs from its digest")
    return {
        "record_id": ident("warc-segment-origin-id") or ident("warc-record-id"), "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": ident("warc-refers-to"),
        "row": int(fields["source-row"]) if "source-row" in fields else None, "chunk_no": int(fields.get("warc-segment-number", 1)) - 1, "segmented": segmented,
        "data": data, "total": int(fields.get("warc-payload-length", size)), "payload_digest": sha("warc-payload-digest"), "running": running}


class _Record:
    """A segmented record on its way through the reader: one incremental digest."""

    def __init__(self, ident: str, row: int, kind: str, total: int, digest: str | None) -> None:
        self.key, self.kind, self.total, self.digest = (ident, row), kind, total, digest
        self.sha, self.bytes, self.next = hashlib.sha1(), 0, 0

    def add(self, data: pa.Buffer, running: str | None) -> None:
        self.sha.update(data)
        self.bytes += len(data)
        self.next += 1
        if running not in (None, base32_sha1(self.sha.copy().digest())):
            raise ValueError(f"record {self.key[0]}: chunk {self.next - 1} differs from its digest")

    def done(self) -> dict:
        found = base32_sha1(self.sha.digest())
        if self.bytes != self.total or self.digest not in (None, found):
            raise ValueError(f"record {self.key[0]}: {self.bytes} of {self.total} bytes, or another digest")
        return {"record_id": self.key[0], "record_type": self.kind, "refers_to": None, "payload_bytes": self.bytes, "payload_digest": found}


def digests(chunks: DataFrame) -> DataFrame:
    """(record_id, record_type, refers_to, payload_bytes, payload_digest) of every record read.

    Bytes and digest of stored payloads come from the data itself; those of a revisit from its
    header. Only segmented records are shuffled: their chunks arrive in order and feed one
    incremental digest; at no time is there more than a batch of chunks in memory. Chunks that a
    segmented record lacks, and bytes that differ from a digest, make the job fail.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Record | None = None
        for batch in batches:
            out = []
            col = {c: batch.column(c) for c in batch.schema.names}
            at = lambda c, k: col[c][k].as_py()
            for k in range(batch.num_rows):
                if now is None or now.key != (at("record_id", k), at("row", k)):
                    if now:
                        out.append(now.done())
                    now = _Record(at("record_id", k), at("row", k), at("record_type", k), at("total", k), at("payload_digest", k))
                if at("chunk_no", k) == now.next:  # a repeated chunk is passed over
                    now.add(col["data"][k].as_buffer(), at("running", k))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if now:
            yield pa.RecordBatch.from_pylist([now.done()], schema)

    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
    size = F.when(F.col("record_type") == "revisit", F.col("total")).otherwise(F.octet_length("data").cast("long"))
    plain = chunks.where("not segmented").select("record_id", "record_type", "refers_to", size.alias("payload_bytes"), F.coalesce("running", "payload_digest").alias("payload_digest"))
    parts = chunks.where("segmented").select("record_id", "row", "record_type", "chunk_no", "total", "data", "payload_digest", "running")
    ordered = parts.repartition(F.col("record_id"), F.col("row")).sortWithinPartitions("record_id", "row", "chunk_no")
    return plain.unionByName(ordered.mapInArrow(run, "record_id string, record_type string, refers_to string, payload_bytes long, payload_digest string"))


def payload_key() -> Column:
    return F.concat_ws(":", F.sha2("payload", 256), F.octet_length("payload"))


def revisits(records: DataFrame, *, least: int = 0) -> DataFrame:
    """(record_id, key, refers_to) of the records whose payload equals that of a record with a larger id.

    records: (record_id, payload). key: the payload's. Payloads of fewer than `least` bytes are never revisits.
    """
    keyed = records.where(F.octet_length("payload") >= least).select("record_id", payload_key().alias("key")).withColumn("row", F.struct("record_id", "key"))
    found = copies_of(keyed, "key", "row", lambda _: F.max("record_id"))
    return found.where("row.record_id < _rep").select("row.*", F.col("_rep").alias("refers_to"))


def archive(pages: DataFrame, path: str, *, least: int = 0, chunk: int = CHUNK, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Writes one record per row of pages; later equal payloads are kept, earlier ones refer to them.

    A null payload is empty. Repeated rows with the same id and payload are all responses. Rows
    with a null id get the record id `null`. An empty table makes an archive without records. A
    payload of any length is written in segments of at most `chunk` bytes. Other columns are ignored.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    records = pages.select(F.col(id_col).alias("record_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    again = written(revisits(records, least=least).distinct(), "revisits")
    marked = join_checked(records.withColumn("key", payload_key()), again, ["record_id", "key"], "left")
    marked = marked.withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))
    write_warc(chunk_table(marked, chunk=chunk), path)
