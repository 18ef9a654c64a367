"""Landed JSON records decoded into typed tables, and the filtered scans over them.

Each decoder is a projection over a struct or string column; filters on its plain columns reach
the Parquet scan once the decoded table is written.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import fixed
from lodestone.functions.text import chunk_citations, iso_date, safe_key, strip_tags

CASE = "caseNumber string, court string, filingDate string, caseType string, county string, summary string, parties array<struct<name:string>>, documents array<struct<documentId:string,title:string,filedDate:string,downloadUrl:string>>"
OPINION = "id string, case_name string, court string, date_filed string, plain_text string, html_with_citations string, html string, citations array<string>"
REPORT = "county string, year int, filings long, dispositions long, pending long"
#: Landed record kinds: DDL, and the fields that are dates.
KINDS = {
    "protection_order": ("orderId string, respondentLastName string, respondentFirstName string, county string, status string, issuedDate string, expiryDate string", ("issuedDate", "expiryDate")),
    "caseload_report": (REPORT, ()),
    "efiling": ("envelopeId string, caseNumber string, county string, status string, acceptedDate string, documentTypes array<string>", ("acceptedDate",)),
    "driving_record": ("recordId string, licenseNumber string, caseNumber string, status string, convictions array<string>, updatedDate string", ("updatedDate",)),
    "warehouse_record": ("recordId string, caseNumber string, county string, documentType string, filedDate string, contentUrl string", ("filedDate",)),
}


def decoded(lines: DataFrame, kind: str, column: str = "value") -> DataFrame:
    """Typed rows of a record kind; dates that cannot be read are null; `bad` keeps unreadable lines."""
    ddl, dates = KINDS[kind]
    rows = from_json_lines(lines, ddl, column)
    return rows.withColumns({c: iso_date(c) for c in dates}) if dates else rows


def from_json_lines(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Rows decoded by a schema; unreadable lines give a row of nulls with the line in `bad`."""
    got = lines.withColumn("r", F.from_json(column, schema))
    return got.select("r.*", F.when(F.to_json("r") == "{}", F.col(column)).alias("bad"))


def cases(raw: DataFrame) -> DataFrame:
    """Court cases with defaults for what is missing; parties are names."""
    named = F.filter(F.transform(F.coalesce("parties", F.array().cast("array<struct<name:string>>")), lambda p: p["name"]), lambda n: n.isNotNull())
    return raw.select(
        F.col("caseNumber").alias("case_number"), F.coalesce("court", F.lit("")).alias("court"), F.coalesce("caseType", F.lit("Unknown")).alias("case_type"), F.coalesce("county", F.lit("Indiana")).alias("county"),
        iso_date("filingDate").alias("filing_date"), F.coalesce("summary", F.lit("")).alias("summary"), named.alias("parties"))


def case_documents(raw: DataFrame) -> DataFrame:
    d = raw.select(F.col("caseNumber").alias("case_number"), F.explode("documents").alias("d"))
    return d.select("case_number", F.col("d.documentId").alias("document_id"), F.col("d.title").alias("title"), iso_date(F.col("d.filedDate")).alias("filed_date"), F.col("d.downloadUrl").alias("download_url"))


def _like(part: str) -> str:
    """A pattern for ilike that finds the part anywhere; its own wildcards are plain characters."""
    return "%" + part.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"


def case_detail(cases: DataFrame, documents: DataFrame, number: str) -> DataFrame:
    """One case with its documents (array of structs, by id); no row if there is no such case."""
    case = case_by_number(cases, number)
    own = documents.where(F.col("case_number") == safe_key(F.lit(number)))  # the documents of one case
    docs = own.groupBy("case_number").agg(F.array_sort(F.collect_list(F.struct(*[c for c in documents.columns if c != "case_number"]))).alias("documents"))
    return case.join(docs, "case_number", "left")


def search_cases(rows: DataFrame, *, text: str | None = None, county: str | None = None, case_type: str | None = None, date_from: date | None = None, date_to: date | None = None, party: str | None = None, page: int = 1, page_size: int = 50) -> DataFrame:
    """One page of matching cases, newest first. Only given filters apply; county and type are exact."""
    for column, value in (("county", county), ("case_type", case_type)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    rows = rows if date_from is None else rows.where(F.col("filing_date") >= F.lit(date_from))
    rows = rows if date_to is None else rows.where(F.col("filing_date") <= F.lit(date_to))
    rows = rows if text is None else rows.where(F.col("summary").ilike(_like(text)))
    rows = rows if party is None else rows.where(F.exists("parties", lambda p: p.ilike(_like(party))))
    return rows.orderBy(F.desc("filing_date"), "case_number").offset((page - 1) * page_size).limit(page_size)


def case_by_number(rows: DataFrame, number: str) -> DataFrame:
    return rows.where(F.col("case_number") == safe_key(F.lit(number))).limit(1)


def recent_filings(rows: DataFrame, today: Column, days: int = 7, county: str | None = None) -> DataFrame:
    rows = rows if county is None else rows.where(F.col("county") == county)
    return rows.where(F.col("filing_date") >= F.date_sub(today, days))


def with_names(rows: DataFrame, code: str, names: DataFrame, raw: str, out: str) -> DataFrame:
    """Code -> name by a small dimension (code, name); else the raw value, else 'Unknown'."""
    dim = names.select(F.col("code").alias(code), F.col("name").alias("_name"))
    return rows.join(dim, code, "left").withColumn(out, F.coalesce("_name", F.when(F.col(raw) != "", F.col(raw)), F.lit("Unknown"))).drop("_name")


def county_dimension(spark: SparkSession) -> DataFrame:
    """(code, name) of the state's counties, numbered in alphabetical order."""
    return spark.createDataFrame([(k, n) for k, n in enumerate(fixed.COUNTY_NAMES, 1)], "code int, name string")


def case_type_dimension(spark: SparkSession) -> DataFrame:
    """(code, name) of the case types."""
    return spark.createDataFrame([*fixed.CASE_CODES.items()], "code string, name string")


def opinions(raw: DataFrame, least: int = 100) -> DataFrame:
    """Opinions with text from the first source that has any; shorter ones are dropped."""
    some = lambda c: F.when(F.trim(c) != "", c)
    text = F.coalesce(some(F.col("plain_text")), some(strip_tags("html_with_citations")), some(strip_tags("html")))
    cites = F.filter(F.coalesce("citations", F.array().cast("array<string>")), lambda c: c.isNotNull() & (c != ""))
    return raw.select(F.col("id").alias("source_id"), "case_name", "court", iso_date("date_filed").alias("date_filed"), text.alias("text"), cites.alias("citations")).where(F.char_length("text") >= least)


def newest_per_court(rows: DataFrame, per_court: int, *, date_from: date | None = None, date_to: date | None = None) -> DataFrame:
    """The newest opinions of each court within the dates: top-n per group; Spark prunes each partition before the shuffle."""
    rows = rows if date_from is None else rows.where(F.col("date_filed") >= F.lit(date_from))
    rows = rows if date_to is None else rows.where(F.col("date_filed") <= F.lit(date_to))
    order = Window.partitionBy("court").orderBy(F.desc("date_filed"), "source_id")
    return rows.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= per_court).drop("_k")


def opinion_pages(rows: DataFrame, court: str, *, date_from: date | None = None, date_to: date | None = None, page_size: int = 20, max_pages: int = 5) -> DataFrame:
    """The newest opinions of one court: at most max_pages pages of at most 100 rows; adds the page number."""
    size = min(page_size, 100)
    found = newest_per_court(rows.where(F.col("court") == court), size * max_pages, date_from=date_from, date_to=date_to)
    return found.withColumn("page", F.ceil(F.row_number().over(Window.orderBy(F.desc("date_filed"), "source_id")) / size).cast("int"))  # a bounded list


def newest_volumes(files: DataFrame, volumes: int, per_volume: int) -> DataFrame:
    """files (volume, name): the first files of the volumes whose names sort last."""
    top = files.select("volume").distinct().orderBy(F.desc("volume")).limit(volumes)
    order = Window.partitionBy("volume").orderBy("name")
    return files.join(top, "volume", "left_semi").withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= per_volume).drop("_k")


def html_opinions(raw: DataFrame, sign: str, this_year: int, least: int = 200) -> DataFrame:
    """raw (source_id, html): regional opinions; first line is the name, an early four-digit number the year."""
    rows = raw.select("source_id", F.trim(F.regexp_replace(F.regexp_replace("html", r"(?i)</(?:p|h\d|div|title)>|<br\s*/?>", "\n"), "<[^>]+>", " ")).alias("text"))
    rows = rows.where((F.char_length("text") >= least) & F.left("text", F.lit(2000)).rlike(sign))
    year = F.regexp_extract(F.left("text", F.lit(500)), r"\b(\d{4})\b", 1)
    clamped = F.when(year == "", F.lit(2000)).otherwise(F.least(F.lit(this_year), F.greatest(F.lit(1900), year.try_cast("int"))))
    return rows.select("source_id", F.trim(F.element_at(F.split("text", "\n"), 1)).alias("case_name"), clamped.alias("year"), F.array_distinct(chunk_citations("text")).alias("citations"), "text")


def flatten_statutes(titles: DataFrame) -> DataFrame:
    """title -> articles -> chapters -> sections as rows with the citation and id of each section; an unreadable effective date is null."""
    a = titles.select("title", F.explode("articles").alias("a"))
    c = a.select("title", F.col("a.article").alias("article"), F.explode("a.chapters").alias("c"))
    s = c.select("title", "article", F.col("c.chapter").alias("chapter"), F.explode("c.sections").alias("s"))
    key = F.concat_ws("-", "title", "article", "chapter", F.col("s.section"))
    dated = [iso_date(F.col("s.effective")).alias("effective_date")] if "effective" in s.schema["s"].dataType.fieldNames() else []
    return s.select("title", "article", "chapter", F.col("s.section").alias("section"), *dated, F.concat(F.lit("Ind. Code § "), key).alias("citation"), F.concat(F.lit("ic-"), key).alias("source_id"), F.col("s.text").alias("text"))


def statute_section(rows: DataFrame, title: str, article: str, chapter: str, section: str) -> DataFrame:
    return rows.where((F.col("title") == title) & (F.col("article") == article) & (F.col("chapter") == chapter) & (F.col("section") == section))


def caseload(reports: DataFrame) -> DataFrame:
    """Adds the clearance rate: dispositions by filings, half-even to four places, 0 without filings."""
    rate = F.when(F.col("filings") == 0, 0.0).otherwise(F.bround(F.col("dispositions") / F.col("filings"), 4))
    return reports.withColumn("clearance_rate", rate)


def matching(rows: DataFrame, **equal) -> DataFrame:
    """Rows that equal the given values; None means any. Serves orders, e-filings, driving and warehouse records."""
    for column, value in equal.items():
        rows = rows if value is None else rows.where(F.col(column) == value)
    return rows


def statewide(reports: DataFrame) -> DataFrame:
    """(year, filings, dispositions, pending, clearance_rate) over all counties."""
    return caseload(reports.groupBy("year").agg(*[F.sum(c).alias(c) for c in ("filings", "dispositions", "pending")]))


def active_orders(orders: DataFrame, county: str, today: Column) -> DataFrame:
    """Protection orders of a county that are active and not expired today; without an expiry date they stay active."""
    open_ = F.col("expiryDate").isNull() | (F.col("expiryDate") >= today)
    return orders.where((F.col("county") == county) & (F.lower("status") == "active") & open_)


def recently_accepted(efilings: DataFrame, today: Column, days: int = 7, county: str | None = None) -> DataFrame:
    """E-filings accepted within the last days."""
    rows = efilings if county is None else efilings.where(F.col("county") == county)
    return rows.where((F.lower("status") == "accepted") & (F.col("acceptedDate") >= F.date_sub(today, days)))


def paged(rows: DataFrame, order: list[Column | str], page: int = 1, page_size: int = 50) -> DataFrame:
    """One page of rows in a total order."""
    return rows.orderBy(*order).offset((page - 1) * page_size).limit(page_size)
