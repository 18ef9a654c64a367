"""Queries over what is stored and lives on between calls: tables, indexes."""

from __future__ import annotations

import io
import re
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.operators import fulltext, graph, ivfpq, knn, names
from lodestone.operators.segments import SegmentedIndex
from lodestone.plans.catalog import _bm25_sql, _without_sql
from lodestone.plans.registry import literal, query, table
from lodestone.sources import archives, paged
from lodestone.sources.tables import StoredTable, chunk_table, record_versions, version_table
from lodestone.storage import scratch_path, written
from lodestone.streaming import ingest, state

RARE = ("license", "worthless", "ertion", "token")

_BATCHES = """WITH one AS (SELECT doc_id, source, md5(text) AS content, lang AS first FROM documents),
two AS (SELECT doc_id, source, content || '!' AS content, 'late' AS first FROM one WHERE doc_id % 100 = 7 UNION ALL SELECT doc_id + 1000000, source, content, 'new' FROM one WHERE doc_id % 50 = 3)"""


def _batches(spark, sf_dir):
    one = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("content"), F.col("lang").alias("first"))
    late = one.where("doc_id % 100 = 7").withColumns({"content": F.concat("content", F.lit("!")), "first": F.lit("late")})
    new = one.where("doc_id % 50 = 3").withColumns({"doc_id": F.col("doc_id") + 1000000, "first": F.lit("new")})
    return one, late.unionByName(new)


@query(_BATCHES + """ SELECT doc_id, source, coalesce(two.content, one.content) AS content, coalesce(one.first, two.first) AS first, 3 AS version
FROM one FULL JOIN two USING (doc_id, source) WHERE source IS DISTINCT FROM 'src3'""")
def stored_upserts(spark, sf_dir):
    """Three upserts and a deletion: the columns in keep stay as first stored, a repeated batch makes no version."""
    kept = StoredTable(spark, scratch_path(spark, "stored"), "doc_id long, source string, content string, first string", key="doc_id", by="source", keep=("first",), buckets=16)
    one, two = _batches(spark, sf_dir)
    for batch in (one, two, two):
        kept.merge(batch)
    kept.delete(spark.createDataFrame([("src3",)], "source string"))
    return kept.read().withColumn("version", F.lit(kept.version()))


@query("""WITH f AS (SELECT source AS source_id, source || '@' || left(sha256(text), 12) AS version_id, min(doc_id + doc_id % 3 * 1000000) AS seen FROM documents WHERE source IS NOT NULL AND text IS NOT NULL GROUP BY 1, 2)
SELECT version_id, seen, row_number() OVER (PARTITION BY source_id ORDER BY seen DESC, version_id DESC) = 1 AS is_current FROM f""")
def stored_versions(spark, sf_dir):
    """Versions recorded in three batches, one of them twice: a content that its source has had stays as it is."""
    kept = version_table(spark, scratch_path(spark, "versions"), buckets=16)
    at = F.col("doc_id") + F.col("doc_id") % 3 * 1000000
    rows = table(spark, sf_dir, "documents").where("source is not null and text is not null").select("doc_id", F.col("source").alias("source_id"), F.col("text").alias("content"), F.timestamp_seconds(at).alias("ingested_at"))
    for part in (0, 1, 1, 2):
        record_versions(kept, rows.where(F.col("doc_id") % 3 == part))
    return kept.read().select("version_id", F.unix_seconds("ingested_at").alias("seen"), "is_current")


@query("""WITH f AS (SELECT source, source || '@' || left(sha256(text), 12) AS version_id, min(doc_id) AS seen FROM documents WHERE source IS NOT NULL AND text IS NOT NULL GROUP BY 1, 2)
SELECT version_id, seen = max(seen) OVER (PARTITION BY source) AS chunked FROM f""")
def stored_ingest(spark, sf_dir):
    """Documents as a stream into stored tables, run twice; of each source the content that was first seen last is chunked."""
    landed, v, c, cp = (scratch_path(spark, x) for x in ("landed", "versions", "chunks", "cp"))
    rows = table(spark, sf_dir, "documents").where("source is not null and text is not null")
    rows = rows.select(F.col("source").alias("source_id"), F.col("text").alias("content"), F.timestamp_seconds("doc_id").alias("ingested_at"))
    rows.write.parquet(landed)
    versions, chunks = version_table(spark, v, 16), chunk_table(spark, c, 16)
    for turn in range(2):
        ingest.run_stored_ingest(spark.readStream.schema(rows.schema).parquet(landed), versions, chunks, f"{cp}-{turn}").awaitTermination()
    known = chunks.read().select("source_id").distinct()
    return versions.read().join(known.withColumn("_some", F.lit(True)), "source_id", "left").select("version_id", (F.col("is_current") & F.coalesce("_some", F.lit(False))).alias("chunked"))


_SOUGHT = "the licensing of worthless tokens"
#: all forms of the sought lexemes that occur in the tables, and more
_FORMS = (["license", "licensed", "licenses", "licensing"], ["worthless", "worthlessly", "worthlessness"], ["token", "tokens", "tokened", "tokening"])
_PLACES = ", ".join(f"list_filter(range(1, len(w) + 1), lambda i: list_contains({literal(f)}, w[i])) AS p{k}" for k, f in enumerate(_FORMS))
_PAIRS = ", ".join(
    f"coalesce(list_sum(list_transform(p{i}, lambda a: coalesce(list_sum(list_transform(list_filter(p{j}, lambda b: abs(a - b) BETWEEN 1 AND 100), lambda b: ln(1 - 0.1 / sqrt(1.005 + 0.05 * exp(abs(a - b) / 1.5 - 2))))), 0))), 0) AS l{i}{j}"
    for i, j in ((0, 1), (0, 2), (1, 2)))
_RANKED = f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents), p AS (SELECT doc_id, {_PLACES} FROM t),
s AS (SELECT doc_id, {_PAIRS} FROM p WHERE len(p0) + len(p1) + len(p2) > 0),
r AS (SELECT doc_id AS id, CASE WHEN l01 + l02 + l12 = 0 THEN 1e-20 ELSE 1 - exp(l01 + l02 + l12) END AS score FROM s)
SELECT id, round(score, 9) AS score FROM r ORDER BY round(r.score, 12) DESC, id LIMIT 100"""


@query(_RANKED)
def fulltext_ranked(spark, sf_dir):
    hits = fulltext.scan_hits(table(spark, sf_dir, "documents"), fulltext.lexemes(_SOUGHT))
    return fulltext.fulltext_search(hits, 100).withColumn("score", F.round("score", 9))


@query(_RANKED)
def fulltext_indexed(spark, sf_dir):
    path = scratch_path(spark, "fulltext")
    fulltext.build_fulltext(table(spark, sf_dir, "documents"), path)
    return fulltext.fulltext_search(fulltext.index_hits(spark, path, fulltext.lexemes(_SOUGHT)), 100).withColumn("score", F.round("score", 9))


@query()
def ivfpq_recall(spark, sf_dir):
    """Recall of the stored index for every query (ids divisible by 100) against all rows, and the rows that each scores exactly."""
    vectors, path = table(spark, sf_dir, "embeddings"), scratch_path(spark, "ivfpq")
    asked = vectors.where("vec_id % 100 = 0")
    ivfpq.build(vectors, path)
    probes = -(-3 * len(ivfpq.load_model(spark, path).centres) // 4)
    found = ivfpq.search(spark, path, asked, 10, probes=probes, rerank=100)
    return knn.recall(found, knn.knn_batch(vectors, asked, 10), 10)


def _drained(spark, batches, make, mode="append"):
    """What make(stream) gives over batches, each some files and a trigger, as a stored table of rows."""
    landed, out, cp = (scratch_path(spark, x) for x in ("landed", "out", "cp"))
    for k, batch in enumerate(batches):
        batch.write.mode("append").parquet(landed)
        q = make(spark.readStream.schema(batch.schema).parquet(landed)).writeStream.outputMode(mode).option("checkpointLocation", cp)
        q.foreachBatch(lambda d, n, k=k: d.withColumn("_part", F.lit(k)).write.mode("append").parquet(out)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query("""SELECT doc_id::VARCHAR AS message_id, CASE WHEN doc_id % 5 < 3 AND doc_id % 7 > 0 THEN 'done' ELSE 'dead' END AS event, CASE WHEN doc_id % 5 < 3 AND doc_id % 7 > 0 THEN doc_id % 5 + 1 ELSE 3 END::INTEGER AS attempt,
doc_id + 86400 + CASE WHEN doc_id % 5 < 3 AND doc_id % 7 > 0 THEN 300 * (doc_id % 5) + 5 ELSE 900 END AS seconds FROM documents""")
def redelivered(spark, sf_dir):
    """A message for every document, whose handler fails doc_id % 5 times, or always if 7 divides doc_id: how each ends."""
    ids = table(spark, sf_dir, "documents").select("doc_id")
    sent = ids.select(F.col("doc_id").cast("string").alias("message_id"), F.lit("sent").alias("kind"), F.timestamp_seconds(F.col("doc_id") + 86400).alias("ts"))
    done = ids.where("doc_id % 7 > 0").select(F.col("doc_id").cast("string").alias("message_id"), F.lit("done").alias("kind"), F.timestamp_seconds(F.col("doc_id") + 86405 + 300 * (F.col("doc_id") % 5)).alias("ts"))
    clock = ids.agg(F.max("doc_id")).select(F.lit("clock").alias("message_id"), F.lit("sent").alias("kind"), F.timestamp_seconds(F.col("max(doc_id)") + 91400).alias("ts"))
    told = _drained(spark, [sent.unionByName(done), clock], state.redelivery_stream)
    ends = told.where("event in ('done', 'dead') and message_id <> 'clock'")
    return ends.select("message_id", "event", "attempt", F.unix_seconds(F.col("at").cast("timestamp")).alias("seconds"))


@query("""SELECT user_id::VARCHAR AS token, epoch_us(ts) AS seen, ts >= (TIMESTAMP '2024-01-01' + INTERVAL (user_id % 20) DAY) OR user_id % 3 > 0 AS allowed FROM events""")
def revoked_uses(spark, sf_dir):
    """Every event is a use of its user's token; those of every third user are revoked until some day."""
    events = table(spark, sf_dir, "events").select(F.col("user_id"), F.col("ts").cast("timestamp").alias("ts"))
    first = events.agg(F.min("ts")).first()[0]
    uses = events.select(F.col("user_id").cast("string").alias("token"), F.lit("used").alias("kind"), "ts", F.lit(None).cast("timestamp").alias("until"))
    day = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01").cast("timestamp")) + 86400 * (F.col("user_id") % 20))
    barred = events.where("user_id % 3 = 0").select("user_id").distinct()
    revoked = barred.select(F.col("user_id").cast("string").alias("token"), F.lit("revoked").alias("kind"), F.lit(first).alias("ts"), day.alias("until"))
    told = _drained(spark, [uses.unionByName(revoked)], state.revocation_stream)
    return told.select("token", F.unix_micros(F.col("ts").cast("timestamp")).alias("seen"), "allowed")


_LAST = "SELECT event_type AS key, value, count(*) OVER (PARTITION BY event_type) AS seen, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, value DESC) AS k FROM events"


@query(f"""SELECT key, len(v) AS n, seen, v[1 + least(len(v) - 1, floor(0.5 * len(v)))::INT] AS p50, v[1 + least(len(v) - 1, floor(0.95 * len(v)))::INT] AS p95, v[1 + least(len(v) - 1, floor(0.99 * len(v)))::INT] AS p99
FROM (SELECT key, seen, list_sort(list(value::DOUBLE)) AS v FROM ({_LAST}) WHERE k <= 1000 GROUP BY ALL)""")
def latency_buffer(spark, sf_dir):
    """Percentiles of the last 1000 values of each kind of event, kept in a stream's state over three triggers."""
    events = table(spark, sf_dir, "events").select("event_type", F.col("value").cast("double").alias("value"), F.col("ts").cast("timestamp").alias("ts"))
    a, b = (F.timestamp_micros(F.lit(int(x))) for x in events.select(F.unix_micros("ts").alias("t")).approxQuantile("t", [0.3, 0.7], 0.01))
    parts = [events.where(F.col("ts") < a), events.where((F.col("ts") >= a) & (F.col("ts") < b)), events.where(F.col("ts") >= b)]
    told = _drained(spark, parts, lambda s: state.last_samples_stream(s, "event_type", "value", size=1000), "update")
    last = told.groupBy("key").agg(F.max_by(F.struct("n", "seen", "p50", "p95", "p99"), "_part").alias("r"))
    return last.select("key", "r.*")


_TOP = "SELECT id, round(score, 6) AS score FROM bm WHERE id IN (SELECT id FROM tf) ORDER BY round(bm.score, 9) DESC, id LIMIT 50"


def _segmented(spark, sf_dir):
    index, docs = SegmentedIndex(spark, scratch_path(spark, "segments")), table(spark, sf_dir, "documents")
    for part in range(3):
        index.add(docs.where(F.col("doc_id") % 3 == part))
    return index


@query(f"WITH {_bm25_sql('documents', RARE)} {_TOP}")
def segmented_search(spark, sf_dir):
    """The top of three segments, added one after the other: that of the corpus."""
    return _segmented(spark, sf_dir).search(RARE, 50).withColumn("score", F.round("score", 6))


@query(f"WITH left_ AS (SELECT * FROM documents WHERE source IS DISTINCT FROM 'src1'), {_bm25_sql('left_', RARE)} {_TOP}")
def segmented_merged(spark, sf_dir):
    """A source is deleted, the segments merged: the top of what is left."""
    index = _segmented(spark, sf_dir)
    index.delete_source(spark.createDataFrame([("src1",)], "source string"))
    index.merge()
    return index.search(RARE, 50).withColumn("score", F.round("score", 6))


_CITED = "SELECT DISTINCT l_partkey AS citing_id, (l_partkey * 7 + l_suppkey) % 2000 AS cited_id FROM lineitem WHERE l_orderkey % 29 = 0"


@query(f"""WITH RECURSIVE e AS MATERIALIZED ({_CITED}), r AS (SELECT p_partkey AS start_id, cited_id AS source_id, 1 AS depth FROM part JOIN e ON citing_id = p_partkey WHERE p_partkey % 100 = 0
UNION SELECT start_id, cited_id, depth + 1 FROM r JOIN e ON citing_id = source_id WHERE depth < 5) SELECT start_id, source_id, min(depth) AS depth FROM r GROUP BY ALL""")
def precedents_d5(spark, sf_dir):
    """Five hops from every part whose key is divisible by 100, over parts that cite parts (a 29th of the order lines are citations)."""
    edges = table(spark, sf_dir, "lineitem").where("l_orderkey % 29 = 0").select(F.col("l_partkey").alias("citing_id"), ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % 2000).alias("cited_id"))
    start = table(spark, sf_dir, "part").where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("source_id"))
    return graph.precedents_of_many(edges, start, 5)


@query("""WITH t AS (SELECT doc_id, lower(text) AS t FROM documents), n AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS n FROM part),
m AS (SELECT doc_id, n FROM t JOIN n ON contains(t, n)) SELECT doc_id, arg_min(n, (-length(n), n)) AS found FROM t LEFT JOIN m USING (doc_id) GROUP BY doc_id""")
def longest_name(spark, sf_dir):
    """The longest word of a part's name that each document contains."""
    parts = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("name"))
    return names.longest_name(table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text")), parts).select("doc_id", "found")


@query("""WITH s AS (SELECT event_type AS alarm, floor(epoch(ts) / 300)::BIGINT AS p, max(value)::DOUBLE AS value FROM events GROUP BY 1, 2),
c AS (SELECT alarm, unnest(generate_series(lo, hi)) AS p FROM (SELECT alarm, min(p) AS lo, max(p) AS hi FROM s GROUP BY alarm)), d AS (SELECT alarm, p, value, coalesce(value > 30, false) AS b FROM c LEFT JOIN s USING (alarm, p))
SELECT alarm, p * 300 AS start, value, CASE WHEN sum(b::INT) OVER (PARTITION BY alarm ORDER BY p ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 THEN 'ALARM' ELSE 'OK' END AS state FROM d""")
def alarm_states(spark, sf_dir):
    """An alarm for each kind of event over a stream: periods without events do not breach."""
    events = table(spark, sf_dir, "events").select("event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    last = events.agg(F.max("ts")).first()[0]
    clock = spark.range(1).select(F.lit("clock").alias("event_type"), F.lit(0.0).alias("value"), (F.lit(last) + F.expr("INTERVAL 1 DAY")).alias("ts"))
    told = _drained(spark, [events, clock], lambda s: state.alarm_stream(s, "event_type", F.max("value"), threshold=30, periods=3))
    ends = events.groupBy(F.col("event_type").alias("alarm")).agg(F.max("ts").alias("_last"))  # what comes after a kind's last event is left out, as the SQL does
    return told.join(ends, "alarm").where("period_start <= _last").select("alarm", F.unix_seconds("period_start").alias("start"), "value", "state")


# --- records in pages -----------------------------------------------------------------------


def _land_cases(spark, sf_dir, path, part=None, size=1000):
    """Orders as pages of cases, a court for each priority; every 40th has no date."""
    date = F.when(F.col("o_orderkey") % 40 != 0, F.to_date("o_orderdate"))
    orders = table(spark, sf_dir, "orders")
    cases = (orders if part is None else orders.where(part)).select(
        F.col("o_orderpriority").alias("court"), F.col("o_orderkey").cast("string").alias("case_number"), date.alias("filing_date"), F.col("o_orderstatus").alias("case_type"),
        F.concat(F.lit("County "), F.col("o_custkey") % 10).alias("county"), F.concat(F.lit("Summary "), F.col("o_custkey")).alias("summary"))
    paged.land(cases, path, "court", ["filing_date", "case_number"], size)


_PAGED = "SELECT o_orderpriority AS court, o_orderkey::VARCHAR AS case_number, CASE WHEN o_orderkey % 40 <> 0 THEN o_orderdate::DATE END AS filing_date, 'County ' || (o_custkey % 10) AS county FROM orders"


@query(f"SELECT * FROM ({_PAGED}) WHERE court IN ('1-URGENT', '5-LOW') AND filing_date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AND county IN ('County 3', 'County 4')")
def paged_cases(spark, sf_dir):
    """Cases of two courts, two counties and one year from a paged service: filters reach the source."""
    path = scratch_path(spark, "pages")
    _land_cases(spark, sf_dir, path)
    rows = spark.read.format(paged.register(spark)).option("orderedBy", "filing_date").load(path)
    found = rows.where("court in ('1-URGENT', '5-LOW') and filing_date between date '1996-01-01' and date '1996-12-31' and county in ('County 3', 'County 4')")
    return found.select("court", "case_number", "filing_date", "county")


@query(f"SELECT * FROM ({_PAGED})")
def paged_stream(spark, sf_dir):
    """The pages of a service as a stream: what is landed after the first run is all that the second reads."""
    path, out, cp = (scratch_path(spark, x) for x in ("pages", "cases", "cp"))
    name = paged.register(spark)
    for part in (F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 3 > 0):
        _land_cases(spark, sf_dir, path, part)
        stream = spark.readStream.format(name).load(path).select("court", "case_number", "filing_date", "county")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


class _OneDown(paged.PagedRecords):
    """A service whose court 3-MEDIUM answers its first page only."""

    @classmethod
    def name(cls):
        return "paged_one_down"

    def service(self):
        return _Down(self.options["path"], "court")


class _Down(paged.LandedPages):
    def page(self, group, number):
        if group == "3-MEDIUM" and number > 0:
            raise OSError("this court does not answer")
        return super().page(group, number)


@query(f"SELECT * FROM ({_PAGED}) WHERE court <> '3-MEDIUM'")
def courts_answering(spark, sf_dir):
    """A court that fails while its pages are read leaves the others as they are."""
    path = scratch_path(spark, "pages")
    _land_cases(spark, sf_dir, path, size=100)
    rows = spark.read.format(paged.register(spark, _OneDown)).options(failures="skip", tries="2", pause="0", pagesPerPartition="4").load(path)
    read, _ = paged.answered(written(rows, "answers"))
    return read.select("court", "case_number", "filing_date", "county")


# --- archives -------------------------------------------------------------------------------


def _zip_pages(spark, sf_dir):
    """The pages as statute sections in ZIP archives of 200 entries; every other one has its citation in a heading."""
    path = scratch_path(spark, "zips")
    key = F.col("page_id").cast("string")
    head = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<h2>IC 35-"), key, F.lit("</h2>"))).otherwise("")
    name = F.concat(F.lit("title"), 30 + F.col("page_id") % 5, F.lit("/article"), F.col("page_id") % 7, F.lit("/chapter01/IC_35-42-"), key, F.lit(".html"))
    rows = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 200).alias("archive"), name.alias("name"), F.concat(head, F.lit("<h4>Line "), key, F.lit("</h4>"), F.coalesce("html", F.lit(""))).alias("html"))
    spark.createDataFrame([], "path string").write.parquet(path)  # makes the folder

    def pack(group: pa.Table) -> pa.Table:
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(re.sub("^file:/+", "/", path))
        out = f"{root}/a{group.column('archive')[0].as_py()}.zip"
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            for r in group.sort_by("name").to_pylist():
                z.writestr(zipfile.ZipInfo(r["name"]), r["html"], zipfile.ZIP_DEFLATED)
        part = f"{out}.{uuid.uuid4().hex}"
        with fs.open_output_stream(part) as f:
            f.write(buffer.getvalue())
        fs.move(part, out)
        return pa.table({"path": [out]})

    rows.groupBy("archive").applyInArrow(pack, "path string").count()
    return path


_SECTION_TEXT = f"trim(regexp_replace(array_to_string(list_filter(list_transform(string_split({_without_sql('h')}, chr(1)), lambda t: regexp_replace(t, '^\\s+|\\s+$', '', 'g')), lambda t: t <> ''), ' '), '\\s+', ' ', 'g'))"


@query(f"""WITH p AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '<h2>IC 35-' || page_id || '</h2>' ELSE '' END || '<h4>Line ' || page_id || '</h4>' || coalesce(html, '') AS h FROM pages WHERE page_id % 5 IN (1, 3)),
t AS (SELECT page_id, {_SECTION_TEXT} AS t FROM p) SELECT (30 + page_id % 5)::VARCHAR AS title, (page_id % 7)::VARCHAR AS article, CASE WHEN page_id % 2 = 0 THEN 'IC 35-' ELSE 'IC 35-42-' END || page_id AS citation, 'Line ' || page_id AS catchline, md5(t) AS text FROM t WHERE length(t) >= 30""")
def statute_archives(spark, sf_dir):
    """Sections of two titles out of ZIP archives; entries of other titles are not unpacked."""
    sections, _ = archives.statute_sections(archives.archive_paths(spark, _zip_pages(spark, sf_dir)), ["31", "33"])
    return sections.select("title", "article", "citation", "catchline", F.md5("text").alias("text"))
