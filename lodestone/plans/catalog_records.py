"""Queries of the record sources, sinks, streams and smaller functions, over whole tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from lodestone.functions import embedding, fixed
from lodestone.functions import text as T
from lodestone.operators import evaluate, versions
from lodestone.plans import ingest, search
from lodestone.plans.registry import literal, query, table
from lodestone.sources import documents, records, sinks
from lodestone.storage import scratch_path
from lodestone.streaming import ingest as stream
from lodestone.streaming import windows

# --- files and texts ------------------------------------------------------------------------

_SUFFIX = ["a.PDF", "b.docx", "c.doc", "d.txt", "e.text", "f.HTM", "g.html", "h.bin"]
_KINDS = ["pdf", "docx", "docx", "text", "text", "html", "html", "unknown"]


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 9 = 8 THEN 'pdf' ELSE {literal(_KINDS)}[(p_partkey % 9 + 1)::BIGINT] END AS kind FROM part")
def file_kinds(spark, sf_dir):
    name = F.concat(F.lit("x/"), F.get(F.array(*map(F.lit, [*_SUFFIX, "i.bin"])), (F.col("p_partkey") % 9).cast("int")))
    content = F.when(F.col("p_partkey") % 9 == 8, F.lit(b"%PDF-1.7")).otherwise(F.lit(b"data"))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("path"), content.alias("content")).select("p_partkey", documents.file_kind("path", "content").alias("kind"))


_SQUEEZED = r"regexp_replace(regexp_replace(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')"


@query(f"SELECT doc_id::VARCHAR || '.txt' AS path, 'text' AS kind, md5({_SQUEEZED}) AS text FROM documents")
def plain_text_files(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.encode("text", "utf-8").alias("content"))
    return documents.parse_files(files).where("error is null").select("path", "kind", F.md5("text").alias("text"))


@query(f"SELECT doc_id, md5({_SQUEEZED}) AS text FROM documents")
def normalized_space(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize_space("text")).alias("text"))


_LINKS = "list_filter(regexp_extract_all(html, 'href=\"([^\"?]+)\"', 1), lambda h: NOT starts_with(h, '/') AND NOT starts_with(h, '..') AND NOT contains(h, '://'))"
_LISTING = "SELECT page_id, html || '<a href=\"0_index.html\">x</a><a href=\"op' || page_id || '.htm\">y</a><a href=\"vol' || page_id || '/\">v</a><a href=\"../up\">u</a>' AS html FROM pages"


@query(f"SELECT page_id, array_to_string({_LINKS}, '|') AS links, array_to_string(list_filter({_LINKS}, lambda h: regexp_matches(h, '\\.html?$') AND NOT starts_with(h, '0_')), '|') AS files FROM ({_LISTING})")
def directory_listing(spark, sf_dir):
    key = F.col("page_id").cast("string")
    listing = F.concat("html", F.lit('<a href="0_index.html">x</a><a href="op'), key, F.lit('.htm">y</a><a href="vol'), key, F.lit('/">v</a><a href="../up">u</a>'))
    rows = table(spark, sf_dir, "pages").select("page_id", listing.alias("h"))
    return rows.select("page_id", F.array_join(documents.directory_links(F.col("h")), "|").alias("links"), F.array_join(documents.opinion_files(F.col("h")), "|").alias("files"))


# --- court records --------------------------------------------------------------------------


def _case_lines(spark, sf_dir):
    """Orders as landed JSON: some fields are missing, some dates cannot be read, every 31st line is broken."""
    key = F.col("o_orderkey")
    docs = F.array(F.struct(F.concat(F.lit("d"), key).alias("documentId"), F.lit("Motion").alias("title"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("filedDate"), F.concat(F.lit("http://x/"), key).alias("downloadUrl")))
    case = F.struct(
        key.cast("string").alias("caseNumber"), F.when(key % 2 == 0, "Court A").alias("court"), F.when(key % 3 == 0, "bad date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("filingDate"), F.when(key % 5 != 0, F.col("o_orderpriority")).alias("caseType"),
        F.when(key % 4 != 0, F.concat(F.lit("County "), F.col("o_custkey") % 10)).alias("county"), F.concat(F.lit("Summary 100% of "), F.col("o_orderstatus")).alias("summary"), F.array(F.struct(F.concat(F.lit("Name "), F.col("o_custkey")).alias("name")), F.struct(F.lit(None).cast("string").alias("name"))).alias("parties"), docs.alias("documents"))
    return table(spark, sf_dir, "orders").select(F.when(key % 31 == 0, F.concat(F.lit("{broken "), key)).otherwise(F.to_json(case)).alias("value"))


def _raw_cases(spark, sf_dir):
    return records.from_json_lines(_case_lines(spark, sf_dir), records.CASE).where("bad is null")


_CASES = """c AS (SELECT o_orderkey::VARCHAR AS case_number, CASE WHEN o_orderkey % 2 = 0 THEN 'Court A' ELSE '' END AS court, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority ELSE 'Unknown' END AS case_type, CASE WHEN o_orderkey % 4 <> 0 THEN 'County ' || (o_custkey % 10) ELSE 'Indiana' END AS county,
CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate::DATE END AS filing_date, 'Summary 100% of ' || o_orderstatus AS summary, 'Name ' || o_custkey AS party, o_orderkey, o_orderdate FROM orders WHERE o_orderkey % 31 <> 0)"""


@query(f"WITH {_CASES} SELECT case_number, court, case_type, county, filing_date, summary, party AS parties FROM c")
def cases_decoded(spark, sf_dir):
    return records.cases(_raw_cases(spark, sf_dir)).withColumn("parties", F.array_join("parties", "|"))


@query("SELECT '{broken ' || o_orderkey AS bad FROM orders WHERE o_orderkey % 31 = 0")
def cases_unreadable(spark, sf_dir):
    return records.from_json_lines(_case_lines(spark, sf_dir), records.CASE).where("bad is not null").select("bad")


@query(f"WITH {_CASES} SELECT case_number, filing_date FROM c WHERE lower(summary) LIKE '%100\\% of f%' ESCAPE '\\' AND contains(lower(party), 'name 1') ORDER BY filing_date DESC NULLS LAST, case_number LIMIT 100")
def case_search_text(spark, sf_dir):
    return records.search_cases(records.cases(_raw_cases(spark, sf_dir)), text="100% OF F", party="NAME 1", page_size=100).select("case_number", "filing_date")


@query(f"WITH {_CASES} SELECT case_number, court FROM c WHERE case_number = '65'")
def case_lookup(spark, sf_dir):
    return records.case_by_number(records.cases(_raw_cases(spark, sf_dir)), "6/5").select("case_number", "court")


@query("SELECT o_orderkey::VARCHAR AS case_number, string_agg(l_linenumber || ':' || l_partkey, '|' ORDER BY l_linenumber, l_partkey) AS documents FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey = 7 GROUP BY o_orderkey")
def case_detail(spark, sf_dir):
    cases = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("case_number"))
    docs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("case_number"), "l_linenumber", "l_partkey")
    got = records.case_detail(cases, docs, "7")
    return got.select("case_number", F.array_join(F.transform("documents", lambda d: F.concat_ws(":", d["l_linenumber"], d["l_partkey"])), "|").alias("documents"))


@query("SELECT o_orderkey AS case_number, CASE WHEN o_custkey % 100 BETWEEN 1 AND 92 THEN " + literal(list(fixed.COUNTY_NAMES)) + "[(o_custkey % 100)::BIGINT] ELSE 'Unknown' END AS county, coalesce(" + "CASE o_orderstatus WHEN 'F' THEN 'Criminal Felony' WHEN 'O' THEN 'Small Claims' END" + ", o_orderstatus) AS case_type FROM orders")
def county_and_type_names(spark, sf_dir):
    code = F.when(F.col("o_orderstatus") == "F", "CF").when(F.col("o_orderstatus") == "O", "SC").otherwise("??")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_number"), (F.col("o_custkey") % 100).cast("int").alias("c"), code.alias("t"), F.lit("").alias("none"), "o_orderstatus")
    named = records.with_names(rows, "c", records.county_dimension(spark), "none", "county")
    return records.with_names(named, "t", records.case_type_dimension(spark), "o_orderstatus", "case_type").select("case_number", "county", "case_type")


@query("SELECT o_orderkey AS source_id, o_orderdate::DATE AS date_filed, ((row_number() OVER (ORDER BY o_orderdate::DATE DESC, o_orderkey) - 1) // 100 + 1)::INTEGER AS page FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate::DATE BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' ORDER BY date_filed DESC, source_id LIMIT 300")
def opinion_pages(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("court"), F.to_date("o_orderdate").alias("date_filed"), F.col("o_orderkey").alias("source_id"))
    return records.opinion_pages(rows, "1-URGENT", date_from=date(1996, 1, 1), date_to=date(1998, 12, 31), page_size=500, max_pages=3).select("source_id", "date_filed", "page")


@query("SELECT 'a' AS court, s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT 'b', c_custkey, NULL FROM customer")
def union_of_courts(spark, sf_dir):
    def broken():
        raise OSError("this court does not answer")

    return ingest.union_of_courts({"a": table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), "x": broken, "b": lambda: table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))}).select("court", "id", "name")


_STRIPPED = r"trim(regexp_replace(regexp_replace({0}, '<[^>]+>', ' ', 'g'), '\s{{2,}}', ' ', 'g'))"
_OPINION = f"CASE WHEN page_id % 3 = 0 THEN url || ' ' || url || ' ' || url || ' ' || url WHEN page_id % 3 = 1 THEN {_STRIPPED.format('html')} ELSE {_STRIPPED.format('html')} END"


@query(f"SELECT page_id::VARCHAR AS source_id, md5(t) AS text, url AS citations FROM (SELECT page_id, url, {_OPINION} AS t FROM pages) WHERE length(t) >= 100")
def opinions_decoded(spark, sf_dir):
    key = F.col("page_id")
    raw = table(spark, sf_dir, "pages").select(
        key.cast("string").alias("id"), F.lit("n").alias("case_name"), F.lit("c").alias("court"), F.lit("2024-01-02").alias("date_filed"), F.when(key % 3 == 0, F.concat_ws(" ", "url", "url", "url", "url")).otherwise("  ").alias("plain_text"), F.when(key % 3 == 1, F.col("html")).alias("html_with_citations"),
        "html", F.array(F.col("url"), F.lit(""), F.lit(None).cast("string")).alias("citations"))
    return records.opinions(raw).select("source_id", F.md5("text").alias("text"), F.array_join("citations", "|").alias("citations"))


_LINES = r"trim(regexp_replace(regexp_replace(h, '(?i)</(?:p|h\d|div|title)>|<br\s*/?>', chr(10), 'g'), '<[^>]+>', ' ', 'g'))"


@query(f"""WITH t AS (SELECT page_id, {_LINES} AS text FROM (SELECT page_id, '<title>Doe ' || page_id || '</title><p>Seventh Circuit ' || (1850 + page_id % 300) || '</p>' || html AS h FROM pages)), y AS (SELECT *, regexp_extract(left(text, 500), '\\b(\\d{{4}})\\b', 1) AS y FROM t WHERE length(text) >= 200 AND regexp_matches(left(text, 2000), 'Seventh Circuit'))
SELECT page_id::VARCHAR AS source_id, trim(string_split(text, chr(10))[1]) AS case_name, CASE WHEN y = '' THEN 2000 ELSE least(2026, greatest(1900, y::INTEGER)) END AS year, md5(text) AS text FROM y""")
def regional_opinions(spark, sf_dir):
    key = F.col("page_id")
    page = F.concat(F.lit("<title>Doe "), key, F.lit("</title><p>Seventh Circuit "), 1850 + key % 300, F.lit("</p>"), "html")
    raw = table(spark, sf_dir, "pages").select(key.cast("string").alias("source_id"), page.alias("html"))
    return records.html_opinions(raw, "Seventh Circuit", 2026).select("source_id", "case_name", "year", F.md5("text").alias("text"))


def _titles(spark, sf_dir):
    """Regions, nations and suppliers as titles, articles, chapters and sections."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    sections = s.groupBy("n_regionkey", "n_nationkey", (F.col("s_suppkey") % 3).cast("string").alias("chapter")).agg(F.collect_list(F.struct(F.col("s_suppkey").cast("string").alias("section"), F.col("s_name").alias("text"), F.when(F.col("s_suppkey") % 2 == 0, "2024-02-30").otherwise("2024-02-28").alias("effective"))).alias("sections"))
    chapters = sections.groupBy("n_regionkey", F.col("n_nationkey").cast("string").alias("article")).agg(F.collect_list(F.struct("chapter", "sections")).alias("chapters"))
    return chapters.groupBy(F.col("n_regionkey").cast("string").alias("title")).agg(F.collect_list(F.struct("article", "chapters")).alias("articles"))


_SECTIONS = "SELECT n_regionkey::VARCHAR AS title, n_nationkey::VARCHAR AS article, (s_suppkey % 3)::VARCHAR AS chapter, s_suppkey::VARCHAR AS section, CASE WHEN s_suppkey % 2 = 1 THEN DATE '2024-02-28' END AS effective_date, s_name AS text FROM supplier JOIN nation ON s_nationkey = n_nationkey"
_CODED = f"SELECT title, article, chapter, section, effective_date, 'Ind. Code § ' || title || '-' || article || '-' || chapter || '-' || section AS citation, 'ic-' || title || '-' || article || '-' || chapter || '-' || section AS source_id, text FROM ({_SECTIONS})"


@query(_CODED)
def statute_flatten(spark, sf_dir):
    return records.flatten_statutes(_titles(spark, sf_dir))


@query(f"SELECT * FROM ({_CODED}) WHERE section = '7'")
def statute_section(spark, sf_dir):
    rows = records.flatten_statutes(_titles(spark, sf_dir))
    key = rows.where("section = '7'").first()
    return records.statute_section(rows, key["title"], key["article"], key["chapter"], "7")


@query("SELECT doc_id::VARCHAR AS source_id, 0 AS chunk_no, md5(text) AS content, 'ic-' || doc_id || '-000' AS chunk_id FROM (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM (SELECT doc_id, regexp_replace(text, '\\s+', ' ', 'g') AS text, lang FROM documents) WHERE lang IN ('en', 'fr') AND length(text) >= 30)")
def statute_chunks(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("title"), F.col("doc_id").alias("source_id"), F.regexp_replace("text", r"\s+", " ").alias("text"))
    return ingest.statute_chunks(rows, ["en", "fr"]).withColumn("content", F.md5("content"))


# --- other record kinds ---------------------------------------------------------------------


def _decoded(spark, sf_dir, kind, **fields):
    rows = table(spark, sf_dir, "orders").select(F.to_json(F.struct(*[v.cast("string").alias(k) for k, v in fields.items()])).alias("value"))
    return records.decoded(rows, kind)


def _order_day():
    return F.date_format("o_orderdate", "yyyy-MM-dd")


@query("SELECT o_orderkey::VARCHAR AS id FROM orders WHERE o_custkey % 10 = 3 AND o_orderstatus = 'F' AND (o_orderkey % 4 = 0 OR o_orderdate::DATE >= DATE '1998-01-01')")
def active_orders(spark, sf_dir):
    rows = _decoded(spark, sf_dir, "protection_order", orderId=F.col("o_orderkey"), county=F.col("o_custkey") % 10, status=F.when(F.col("o_orderstatus") == "F", "Active").otherwise("Closed"), expiryDate=F.when(F.col("o_orderkey") % 4 != 0, _order_day()))
    return records.active_orders(rows, "3", F.lit(date(1998, 1, 1))).select(F.col("orderId").alias("id"))


@query("SELECT o_orderkey::VARCHAR AS id FROM orders WHERE o_orderstatus = 'O' AND o_orderdate::DATE >= DATE '1998-05-25' AND o_custkey % 10 = 4")
def recently_accepted(spark, sf_dir):
    rows = _decoded(spark, sf_dir, "efiling", envelopeId=F.col("o_orderkey"), county=F.col("o_custkey") % 10, status=F.when(F.col("o_orderstatus") == "O", "accepted").otherwise("rejected"), acceptedDate=_order_day())
    return records.recently_accepted(rows, F.lit(date(1998, 6, 1)), 7, "4").select(F.col("envelopeId").alias("id"))


@query("SELECT o_orderkey::VARCHAR AS id, o_orderdate::DATE AS day FROM orders WHERE o_custkey = 77")
def driving_lookup(spark, sf_dir):
    rows = _decoded(spark, sf_dir, "driving_record", recordId=F.col("o_orderkey"), licenseNumber=F.col("o_custkey"), updatedDate=_order_day())
    return records.matching(rows, licenseNumber="77", caseNumber=None).select(F.col("recordId").alias("id"), F.col("updatedDate").alias("day"))


@query("SELECT o_orderkey::VARCHAR AS id FROM orders WHERE o_custkey % 10 = 5 AND o_orderpriority = '5-LOW' ORDER BY o_orderdate::DATE DESC, o_orderkey::VARCHAR LIMIT 20 OFFSET 20")
def warehouse_page(spark, sf_dir):
    rows = _decoded(spark, sf_dir, "warehouse_record", recordId=F.col("o_orderkey"), county=F.col("o_custkey") % 10, documentType=F.col("o_orderpriority"), filedDate=_order_day())
    found = records.matching(rows, county="5", documentType="5-LOW", caseNumber=None)
    return records.paged(found, [F.desc("filedDate"), "recordId"], page=2, page_size=20).select(F.col("recordId").alias("id"))


@query("SELECT year(o_orderdate)::INTEGER AS year, count(*) AS filings, count(*) FILTER (o_orderstatus = 'F') AS dispositions, count(*) FILTER (o_orderstatus = 'O') AS pending, round_even(count(*) FILTER (o_orderstatus = 'F')::DOUBLE / count(*), 4) AS clearance_rate FROM orders GROUP BY 1")
def statewide_caseload(spark, sf_dir):
    by = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 92).alias("county"), F.year("o_orderdate").alias("year"))
    return records.statewide(by.agg(F.count(F.lit(1)).alias("filings"), F.count_if(F.col("o_orderstatus") == "F").alias("dispositions"), F.count_if(F.col("o_orderstatus") == "O").alias("pending")))


# --- sinks, messages, streams ---------------------------------------------------------------


@query("SELECT md5(l_suppkey || '->' || l_partkey) AS edge_id, left(arg_max(strftime(l_shipdate, '%Y-%m-%d') || repeat('x', 600), (n, l_shipdate)), 500) AS context, arg_min(l_shipdate::DATE, (n, l_shipdate)) AS date_cited FROM (SELECT *, (l_orderkey % 2)::INTEGER AS n FROM lineitem) GROUP BY l_suppkey, l_partkey")
def edges_upserted(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("citing_id"), F.col("l_partkey").alias("cited_id"), F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.repeat(F.lit("x"), 600)).alias("context"), F.to_date("l_shipdate").alias("date_cited"), F.col("l_shipdate").alias("created_at"), F.col("l_orderkey"))
    old = rows.where("l_orderkey % 2 = 0").select(T.edge_id("citing_id", "cited_id").alias("edge_id"), "citing_id", "cited_id", F.left("context", F.lit(500)).alias("context"), "date_cited", "created_at")
    return sinks.edges_upserted(old, rows.where("l_orderkey % 2 = 1").drop("l_orderkey")).select("edge_id", "context", "date_cited")


@query("SELECT o_custkey AS chunk_id, arg_max(o_orderpriority, (n, o_orderkey)) AS content, arg_min(o_orderstatus, (n, o_orderkey)) AS section FROM (SELECT *, (o_orderkey % 2)::INTEGER AS n FROM orders) GROUP BY o_custkey")
def chunks_upserted(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("chunk_id"), F.col("o_orderpriority").alias("content"), F.col("o_orderstatus").alias("section"), F.lit("m").alias("metadata"), F.lit(0).alias("embedding"), F.col("o_orderkey").alias("ingested_at"))
    return sinks.chunks_upserted(rows.where("ingested_at % 2 = 0"), rows.where("ingested_at % 2 = 1")).select("chunk_id", "content", "section")


@query("SELECT o_orderkey, o_orderstatus, ((row_number() OVER (PARTITION BY o_orderstatus, o_custkey % 50 ORDER BY o_orderkey) - 1) // 10 + 1) AS batch_no FROM orders")
def message_batches(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("queue", F.concat_ws(":", "o_orderstatus", F.col("o_custkey") % 50))
    return sinks.in_batches(rows, "queue", "o_orderkey").select("o_orderkey", "o_orderstatus", "batch_no")


@query("SELECT event_type AS agent, ts::DATE AS dt, count(*) AS n FROM events GROUP BY 1, 2")
def audit_records(spark, sf_dir):
    path = scratch_path(spark, "audit")
    runs = table(spark, sf_dir, "events").select(F.col("event_type").alias("agent"), F.col("ts").cast("timestamp").alias("started_at"), "user_id")
    sinks.write_audit(runs, path)
    return spark.read.schema("started_at timestamp, user_id long, agent string, dt date").json(path).groupBy("agent", "dt").agg(F.count(F.lit(1)).alias("n"))


_SENT = f"""WITH {_CASES} SELECT '{{"source_type":"court_case","source_id":"d' || o_orderkey || '","download_url":"http://x/' || o_orderkey || '","metadata":{{"case_number":"' || case_number || '","title":"Motion","filing_date":"' || o_orderdate::DATE || '"}}}}' AS value FROM c WHERE county = 'County 3' AND filing_date >= DATE '1998-05-02'"""


@query(_SENT)
def ingest_messages(spark, sf_dir):
    raw = _raw_cases(spark, sf_dir)
    return ingest.ingest_recent(records.cases(raw), records.case_documents(raw), "County 3", F.lit(date(1998, 6, 1)), 30)


@query(f"SELECT count(*) AS n FROM ({_SENT})")
def ingest_dry_run(spark, sf_dir):
    raw = _raw_cases(spark, sf_dir)
    return ingest.ingest_recent(records.cases(raw), records.case_documents(raw), "County 3", F.lit(date(1998, 6, 1)), 30, dry_run=True)


@query("SELECT CASE WHEN o_orderkey % 17 = 0 OR o_orderkey % 19 = 0 THEN 'poison' ELSE 'good' END AS kind, count(*) AS n FROM orders GROUP BY 1")
def poison_messages(spark, sf_dir):
    """Messages written as JSON lines and read back as a stream; some are broken, some lack their source."""
    key = F.col("o_orderkey")
    good = F.to_json(F.struct(F.lit("s3").alias("source_type"), F.when(key % 19 != 0, key.cast("string")).alias("source_id")))
    path, out = scratch_path(spark, "messages"), scratch_path(spark, "received")
    table(spark, sf_dir, "orders").select(F.when(key % 17 == 0, "{oops").otherwise(good).alias("value")).write.text(path)
    q = stream.message_stream(spark, path).writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, "cp")).option("path", out).trigger(availableNow=True).start()
    q.awaitTermination()
    good_, poison = stream.split_poison(spark.read.parquet(out))
    return good_.select(F.lit("good").alias("kind")).unionByName(poison.select(F.lit("poison").alias("kind"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source || '@' || left(sha256(text), 12) AS version_id FROM documents GROUP BY 1")
def stream_ingest(spark, sf_dir):
    """Documents as a stream into version and chunk tables; a repeated content is one version."""
    landed, v, c, cp = (scratch_path(spark, x) for x in ("landed", "versions", "chunks", "cp"))
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("source_id"), F.col("text").alias("content"), F.timestamp_seconds("doc_id").alias("ingested_at"))
    rows.write.parquet(landed)
    stream.run_ingest(spark.readStream.schema(rows.schema).parquet(landed), v, c, cp).awaitTermination()
    return spark.read.parquet(v).select("version_id")


_TRIES = "o_orderkey % 4 + 1 AS attempts, o_orderkey % 3 = 0 AS failed"


@query(f"SELECT CASE WHEN NOT failed THEN 'done' WHEN attempts < 3 THEN 'again' ELSE 'dead' END AS state, count(*) AS n FROM (SELECT {_TRIES} FROM orders) GROUP BY 1")
def retries(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderkey") % 4).alias("attempts"))
    parts = stream.with_retries(rows, lambda d: d.withColumn("error", F.when(F.col("o_orderkey") % 3 == 0, "failed")))
    out = None
    for state, part in zip(("done", "again", "dead"), parts, strict=True):
        part = part.select(F.lit(state).alias("state"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey AS token_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate > TIMESTAMP '1998-01-01')")
def tokens_not_revoked(spark, sf_dir):
    revoked = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("token_id"), F.col("o_orderdate").alias("expires_at"))
    return windows.not_revoked(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("token_id")), revoked, F.lit("1998-01-01").cast("timestamp"))


@query("SELECT source AS source_id, sha256(text) AS content_hash FROM documents WHERE (source, left(sha256(text), 12)) NOT IN (SELECT source, left(sha256(text), 12) FROM documents WHERE doc_id % 2 = 0) GROUP BY 1, 2")
def new_versions(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("source_id"), F.col("text").alias("content"), "doc_id")
    known = versions.with_hash(rows.where("doc_id % 2 = 0"))
    return versions.new_versions(rows, known).select("source_id", "content_hash")


# --- answers and evaluation sets ------------------------------------------------------------


@query("SELECT doc_id, left(text, 600) AS content, round_even(n_chars / 7.0::DOUBLE, 6) AS score FROM documents")
def presented(spark, sf_dir):
    return search.presented(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), (F.col("n_chars") / 7).alias("score")))


@query("SELECT lang AS query_id, doc_id::VARCHAR AS doc_id, (CASE WHEN toxic = 1 THEN 2 ELSE 1 END)::INTEGER AS grade FROM labels JOIN documents USING (doc_id) WHERE quality = 1 OR toxic = 1")
def judgements(spark, sf_dir):
    """Evaluation sets of each language, an example for every 1000 ids: no row holds the judgements of a whole language."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").where("quality = 1 or toxic = 1").select(F.col("lang").alias("query_id"), F.col("doc_id").cast("string").alias("d"), F.floor(F.col("doc_id") / 1000).alias("part"), "quality", "toxic")
    sets = rows.groupBy("query_id", "part").agg(F.collect_list(F.when(F.col("quality") == 1, F.col("d"))).alias("relevant_source_ids"), F.map_from_entries(F.collect_list(F.when(F.col("toxic") == 1, F.struct("d", F.lit(2))))).alias("graded_relevance"))
    return evaluate.judgements(sets)


_BEST = "r AS (SELECT lang, doc_id, text, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents)"


def _best(spark, sf_dir, n):
    from pyspark.sql.window import Window

    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id"))
    return table(spark, sf_dir, "documents").withColumn("rank", rank).where(F.col("rank") <= n).select("lang", "rank", F.col("doc_id").alias("source_id"), F.col("text").alias("content"))


@query(f"WITH {_BEST} SELECT lang, string_agg(left(text, 400) || ' [SOURCE: ' || doc_id || ']', chr(10) ORDER BY rank) AS answer FROM r WHERE rank <= 6 GROUP BY lang")
def extractive_answers(spark, sf_dir):
    return evaluate.extractive_answer(_best(spark, sf_dir, 20), "lang")


_SAID = "text || CASE WHEN doc_id % 2 = 0 THEN ' [SOURCE: k1, § 2] [SOURCE: u' || doc_id % 5 || ']' ELSE '' END || CASE WHEN doc_id % 7 = 0 THEN ' I do not contain sufficient information' ELSE '' END"
_MARKS = f"list_transform(regexp_extract_all(answer, {literal(fixed.SOURCE_MARK)}, 1), lambda x: trim(x))"
_MISSING = f"list_filter({_MARKS}, lambda c: NOT list_contains(['k1', 'u1', 'u3'], c))"


def _answers(spark, sf_dir):
    key = F.col("doc_id")
    said = F.concat("text", F.when(key % 2 == 0, F.concat(F.lit(" [SOURCE: k1, § 2] [SOURCE: u"), key % 5, F.lit("]"))).otherwise(""), F.when(key % 7 == 0, " I do not contain sufficient information").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", said.alias("answer"), F.when(key % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("k1"), F.lit("u1"), F.lit("u3"))).alias("context_ids"))


@query(f"""SELECT doc_id, array_to_string({_MISSING}, '|') AS missing, len({_MISSING}) = 0 AS is_valid, array_to_string(list_filter([CASE WHEN contains(lower(answer), '{fixed.FALLBACK_SIGN}') THEN 'fallback_response_detected' END, CASE WHEN len({_MARKS}) = 0 THEN 'no_citations_in_output' END], lambda w: w IS NOT NULL), '|') AS warnings
FROM (SELECT doc_id, {_SAID} AS answer FROM documents WHERE doc_id % 11 <> 0)""")
def answers_validated(spark, sf_dir):
    got = evaluate.validated(_answers(spark, sf_dir).where("doc_id % 11 <> 0"))
    return got.select("doc_id", F.array_join("missing", "|").alias("missing"), "is_valid", F.array_join("warnings", "|").alias("warnings"))


@query(f"SELECT doc_id, fell_back, md5(CASE WHEN fell_back THEN 'none' ELSE answer END) AS answer FROM (SELECT doc_id, answer, doc_id % 11 = 0 OR len({_MISSING}) > 0 AS fell_back FROM (SELECT doc_id, {_SAID} AS answer FROM documents))")
def answers_guarded(spark, sf_dir):
    return evaluate.guarded(_answers(spark, sf_dir), "none").select("doc_id", "fell_back", F.md5("answer").alias("answer"))


_LCG = "SELECT doc_id, x0, (1664525 * x0 + 1013904223) % 4294967296 AS x1 FROM (SELECT doc_id, ('0x' || left(md5(text), 8))::BIGINT AS x0 FROM documents)"


@query(f"SELECT doc_id, round((x1 / 2147483648.0::DOUBLE - 1)::FLOAT::DOUBLE, 6) AS a, round((x2 / 2147483648.0::DOUBLE - 1)::FLOAT::DOUBLE, 6) AS b FROM (SELECT doc_id, x1, (1664525 * x1 + 1013904223) % 4294967296 AS x2 FROM ({_LCG}))")
def congruential_vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", embedding.embedded("text", lambda: lambda texts: [embedding.congruential_vector(t, 2) for t in texts]).alias("v"))
    return rows.select("doc_id", *[F.round(F.get("v", F.lit(i)).cast("double"), 6).alias(c) for i, c in enumerate("ab")])


@query("SELECT doc_id, 16 AS size, true AS is_unit FROM documents")
def hash_vectors(spark, sf_dir):
    from lodestone.functions.vectors import norm

    rows = table(spark, sf_dir, "documents").select("doc_id", embedding.embedded("text", lambda: embedding.offline_provider(16)).alias("embedding"))
    return embedding.checked_dimension(rows, 16).select("doc_id", F.size("embedding").alias("size"), (F.abs(norm(F.col("embedding")) - 1) < 1e-5).alias("is_unit"))
