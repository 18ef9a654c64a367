import io
import json
import zipfile
from datetime import date, datetime

from pyspark.sql import functions as F

from lodestone.sources import documents, records, sinks
from lodestone.streaming import ingest, windows


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one   two\n\n\n\nthree")
    (tmp_path / "b.html").write_text("<html><nav>menu</nav><p>Hi &amp; bye</p><script>x</script></html>")
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>First</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Second</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "c.docx").write_bytes(buf.getvalue())
    (tmp_path / "d.bin").write_bytes(b"\xffraw")
    (tmp_path / "e.docx").write_bytes(b"broken")
    got = {r.path.rsplit("/", 1)[1]: r for r in documents.load_documents(spark, str(tmp_path)).collect()}
    assert got["a.txt"].text == "one two\n\nthree" and got["b.html"].text == "Hi & bye" and got["c.docx"].text == "First\nSecond"
    assert got["d.bin"].kind == "unknown" and got["d.bin"].text == "�raw" and got["e.docx"].error


def test_cases(spark):
    lines = [json.dumps({"caseNumber": "1", "filingDate": "2024-02-03", "parties": [{"name": "A"}, {}]}), "{bad", json.dumps({"caseNumber": "2", "county": "Lake", "documents": [{"documentId": "d", "filedDate": "x"}]})]
    raw = records.from_json_lines(spark.createDataFrame([(x,) for x in lines], "value string"), records.CASE)
    rows = {r.case_number: r for r in records.cases(raw.where("bad is null")).collect()}
    assert rows["1"].county == "Indiana" and rows["1"].case_type == "Unknown" and rows["1"].parties == ["A"] and rows["1"].filing_date == date(2024, 2, 3)
    docs = records.case_documents(raw)
    assert docs.first().filed_date is None
    assert json.loads(sinks.messages(docs, "case").first().value)["source_id"] == "d"
    assert records.search_cases(records.cases(raw), party="a").count() == 1


def test_opinions(spark):
    raw = spark.createDataFrame([("1", "n", "c", "2024-01-01", " ", "<p>" + "x" * 120 + "</p>", None, ["a", "", None]), ("2", "n", "c", None, "short", None, None, None)], "id string, case_name string, court string, date_filed string, plain_text string, html_with_citations string, html string, citations array<string>")
    (r,) = records.opinions(raw).collect()
    assert (r.source_id, len(r.text), r.citations) == ("1", 120, ["a"])


def test_ingest_is_idempotent(spark, tmp_path):
    src, v, c = (str(tmp_path / x) for x in ("in", "versions", "chunks"))
    schema = "source_id string, content string, ingested_at timestamp"
    rows = [("a", "text one " * 30, datetime(2024, 1, 1)), ("b", "text two " * 30, datetime(2024, 1, 1))]
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(src)
    for k in range(2):
        stream = spark.readStream.schema(schema).json(src)
        ingest.run_ingest(stream, v, c, str(tmp_path / f"cp{k}")).awaitTermination()
    assert spark.read.parquet(v).count() == 2
    spark.createDataFrame([("a", "new text " * 30, datetime(2024, 1, 2))], schema).coalesce(1).write.mode("append").json(src)
    ingest.run_ingest(spark.readStream.schema(schema).json(src), v, c, str(tmp_path / "cp1")).awaitTermination()
    from lodestone.operators.versions import version_log

    log = version_log(spark.read.parquet(v))
    assert log.count() == 3 and log.where("is_current").count() == 2
    assert {r.content[:8] for r in ingest.current_chunks(spark.read.parquet(c), log).collect()} == {"new text", "text two"}


def test_poison_and_retries(spark):
    rows = spark.createDataFrame([("x", "s3", "1"), ("y", None, None)], "value string, source_type string, source_id string")
    good, poison = ingest.split_poison(rows)
    assert good.count() == poison.count() == 1
    todo = spark.createDataFrame([(1, 0), (2, 2)], "id int, attempts int")
    done, again, dead = ingest.with_retries(todo, lambda d: d.withColumn("error", F.lit("e")))
    assert (done.count(), again.first().id, dead.first().id) == (0, 1, 2)


def test_windows_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "ev")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type").write.parquet(src)
    stream = spark.readStream.schema("ts timestamp_ntz, event_type string").parquet(src)
    q = windows.tumbling_stream(stream, "1 hour", "event_type").writeStream.format("memory").queryName("tumbled").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("tumbled").agg(F.sum("n")).first()[0] == 1000


def test_token_bucket_stream(spark, tmp_path):
    src = str(tmp_path / "ev")
    spark.createDataFrame([(1, datetime(2024, 1, 1, 0, 0, s)) for s in range(4)], "user_id long, ts timestamp").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("user_id long, ts timestamp").parquet(src)
    q = windows.token_bucket_stream(stream, capacity=2, per_second=0.5).writeStream.format("memory").queryName("bucket").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert [r.allowed for r in spark.table("bucket").orderBy("ts").collect()] == [True, True, True, False]


def test_fixed_window_stream_keeps_its_state_and_leaves_late_requests_out(spark, tmp_path):
    src, cp, out = (str(tmp_path / x) for x in ("ev", "cp", "out"))
    at = lambda s: (1, datetime(2024, 1, 1, 0, s // 60, s % 60))
    allowed = {}
    for batch in ([at(0), at(1), at(2)], [at(3), at(61), at(62)], [at(900)], [at(5), at(901)]):
        spark.createDataFrame(batch, "user_id long, ts timestamp").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("user_id long, ts timestamp").parquet(src)
        q = windows.fixed_window_stream(stream, limit=2, seconds=60, late="1 minute").writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    allowed = {(r.ts.minute * 60 + r.ts.second): r.allowed for r in spark.read.parquet(out).collect()}
    assert allowed == {0: True, 1: True, 2: False, 3: False, 61: True, 62: True, 900: True, 901: True}  # 5 s came after the watermark


def test_watermark_drops_late_rows(spark, tmp_path):
    src, cp = str(tmp_path / "ev"), str(tmp_path / "cp")
    for k, minutes in enumerate(([0, 1], [40], [2, 41])):
        spark.createDataFrame([(datetime(2024, 1, 1, 0, m), "a") for m in minutes], "ts timestamp, event_type string").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("ts timestamp, event_type string").parquet(src)
        q = windows.tumbling_stream(stream, "5 minutes", "event_type").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", cp).trigger(availableNow=True).start()
        q.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.window_start.minute, r.n) for r in rows] == [(0, 2)]  # minute 2 came 38 minutes late


def test_revocations(spark):
    t = spark.createDataFrame([("a",), ("b",), ("c",)], "token_id string")
    r = spark.createDataFrame([("a", datetime(2030, 1, 1)), ("b", datetime(2020, 1, 1))], "token_id string, expires_at timestamp")
    assert {x.token_id for x in windows.not_revoked(t, r, F.lit(datetime(2024, 1, 1))).collect()} == {"b", "c"}
