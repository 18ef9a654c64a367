import base64
import gzip
import hashlib
from pathlib import Path

import pytest

from lodestone.llm import warc as W
from lodestone.llm._common import scratch_path

ROWS = [
    (1, "u", b"abc" * 1000), (2, "u", b"abc" * 1000), (3, None, None), (4, "x y\r\n", b""), (5, "u", b"\r\n\r\nWARC/1.0\r\n" * 20), (6, "u", bytes(range(256)) * 50),
    (7, "u", b"q\r\n\r\n"), (8, "u", b"WARC/1.0\r\n\r\n"), (9, "u", b"\r\n\r\n"), (10, "u", b"z\r\n\r\nWARC/1.0"), (11, "u", b"L" * 100_000)]


@pytest.mark.parametrize(("chunk", "compression"), [(100, "gzip"), (1 << 20, "none"), (7, "none")])
def test_round_trip(spark, chunk, compression):
    rows = ROWS[:10] if chunk == 7 else ROWS
    df = spark.createDataFrame(rows, "page_id long, url string, html binary").selectExpr("*", "1 as record_type", "2 as data").repartition(3)
    path = scratch_path(spark, "warc")
    W.archive(df, path, chunk=chunk)
    got = {int(r.record_id): r for r in W.digests(W.read_warc(spark, path)).collect()}
    payload = {i: p or b"" for i, _, p in rows}
    last = {}
    for i, p in payload.items():
        last[p] = max(last.get(p, 0), i)
    assert set(got) == set(payload)
    for i, p in payload.items():
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if last[p] == i else ("revisit", str(last[p])))


def test_chunks_are_bounded_and_files_are_warc(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a/", b"x" * 5000)], "record_id long, url string, payload binary").selectExpr("*", "'response' as record_type", "cast(null as bigint) as refers_to")
    rows = W.chunk_table(df, chunk=1000).orderBy("chunk_no").collect()
    assert [len(r.data) for r in rows] == [1000] * 5 and [r.digested for r in rows] == [1000, 2000, 3000, 4000, 5000]
    path = scratch_path(spark, "warc")
    W.write_warc(W.chunk_table(df, chunk=1000), path)
    # Spark's first task writes its file even if it has no row
    (raw,) = [x for f in Path(path.removeprefix("file:")).glob("*.gz") if (x := gzip.decompress(f.read_bytes()))]
    assert raw.startswith(b"WARC/1.0\r\nWARC-Type: response\r\n") and raw.count(b"WARC-Type: continuation") == 4 and raw.endswith(b"\r\n\r\n") and b"WARC-Segment-Total-Length: 5000" in raw


def test_digests_are_incremental(spark):
    payload = bytes(range(256)) * 20
    df = spark.createDataFrame([(1, "u", payload)], "record_id long, url string, payload binary").selectExpr("*", "'response' as record_type", "cast(null as bigint) as refers_to")
    rows = W.chunk_table(df, chunk=1000).orderBy("chunk_no").collect()
    assert [r.running for r in rows] == [base64.b32encode(hashlib.sha1(payload[: r.digested]).digest()).decode() for r in rows]
    assert {r.payload_digest for r in rows} == {rows[-1].running}


@pytest.mark.parametrize("chunk", [100, 1 << 20])
def test_damaged_archives_fail(spark, chunk):
    path = scratch_path(spark, "warc")
    W.archive(spark.createDataFrame([(1, "u", "good text " * 50)], "page_id long, url string, html string"), path, chunk=chunk)
    records = W.read_warc(spark, path).count()
    assert records == (5 if chunk == 100 else 1)
    value = spark.read.option("lineSep", W.SEPARATOR).text(path).selectExpr("replace(value, 'text good', 'text bood') as value")
    bad = scratch_path(spark, "warc")
    value.coalesce(1).write.option("lineSep", W.SEPARATOR).text(bad)
    with pytest.raises(Exception, match="differs from its digest"):
        W.digests(W.read_warc(spark, bad)).collect()


def test_small_payloads_are_no_revisits_and_null_ids(spark):
    df = spark.createDataFrame([(1, "u", b"aa"), (2, "u", b"aa"), (None, "u", b"bbb"), (3, "u", b"bbb")], "page_id long, url string, html binary")
    path = scratch_path(spark, "warc")
    W.archive(df, path, least=3)
    got = {r.record_id: r.record_type for r in W.digests(W.read_warc(spark, path)).collect()}
    assert got["1"] == got["2"] == "response" and set(got) == {"1", "2", "3", "null"}


def test_empty_table(spark):
    path = scratch_path(spark, "warc")
    W.archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert W.digests(W.read_warc(spark, path)).count() == 0


def test_repeated_and_null_ids_keep_every_record(spark):
    big = [bytes([65 + i]) * 5000 for i in range(3)]
    rows = [(1, "u", big[0]), (1, "u", big[0]), (1, "u", big[1]), (None, "u", big[2]), (None, "u", big[1]), (2, "u", big[0]), (3, "u", b"s"), (3, "u", b"t"), (4, "u", b"s")]
    df = spark.createDataFrame(rows, "page_id long, url string, html binary").repartition(3)
    path = scratch_path(spark, "warc")
    W.archive(df, path, chunk=1000)
    got = sorted((r.record_id, r.payload_digest, r.record_type, r.refers_to or "") for r in W.digests(W.read_warc(spark, path)).collect())
    sha = lambda p: base64.b32encode(hashlib.sha1(p).digest()).decode()
    refers = {(1, big[0]): "2", (3, b"s"): "4"}
    assert got == sorted((str(i or "null"), sha(p), "revisit" if (i, p) in refers else "response", refers.get((i, p), "")) for i, _, p in rows)
