"""Anomaly detectors over filings (source_id, content, parties, filing_date). Each gives indicator rows.

indicator_type, severity, description, evidence array<string>, n_evidence long, confidence double,
metadata map<string,string>. evidence holds the first EVIDENCE sources (by date, then id), so that
an indicator of any size is one bounded row; `evidence_links` has all of them as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import fixed
from lodestone.functions.text import all_matches


EVIDENCE = 1000
_KEY = ("indicator_type", "key")


def _indicator(kind: str, severity: Column, description: Column, confidence: Column, **meta: Column) -> list[Column]:
    pairs = [x for k, v in meta.items() for x in (F.lit(k), v.cast("string"))]
    return [F.lit(kind).alias("indicator_type"), "key", severity.alias("severity"), description.alias("description"), confidence.cast("double").alias("confidence"), F.create_map(*pairs).alias("metadata")]


def _links(kind: str, key: str | Column, rows: DataFrame) -> DataFrame:
    """(indicator_type, key, at, source_id): the sources behind an indicator, in date order where they have one."""
    at = F.col("filing_date") if "filing_date" in rows.columns else F.lit(None).cast("date")
    return rows.select(F.lit(kind).alias("indicator_type"), (F.col(key) if isinstance(key, str) else key).alias("key"), at.alias("at"), F.col("source_id").cast("string").alias("source_id"))


def _with_evidence(found: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """Indicators with the first `most` of their sources and the number of all; top-k per key is cut before the shuffle."""
    first = Window.partitionBy(*_KEY).orderBy("at", "source_id")
    few = links.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= most)
    few = few.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("_k", "source_id"))).alias("e"))
    n = links.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n_evidence"))
    out = found.join(few, list(_KEY)).join(n, list(_KEY))
    return out.select("indicator_type", "severity", "description", F.col("e.source_id").alias("evidence"), "n_evidence", "confidence", "metadata")


def party_filings(filings: DataFrame) -> DataFrame:
    """(party, filing_date, source_id): one row per named party; rows without a date or party drop out."""
    rows = filings.where("filing_date is not null").select(F.explode("parties").alias("p"), "filing_date", "source_id")
    return rows.select(F.lower("p").alias("party"), "filing_date", "source_id").where("party is not null")


def burst_windows(parties: DataFrame, *, days: int = 30, least: int = 6) -> DataFrame:
    """(party, window_start, n): the first start whose forward window of `days` holds `least` filings.

    A range frame per party; a party with very many filings is one sorted, spillable window.
    """
    day = parties.groupBy("party", "filing_date").agg(F.count(F.lit(1)).alias("c")).withColumn("d", F.unix_date("filing_date"))
    ahead = Window.partitionBy("party").orderBy("d").rangeBetween(0, days)
    hit = day.withColumn("n", F.sum("c").over(ahead)).where(F.col("n") >= least)
    return hit.groupBy("party").agg(F.min_by(F.struct("filing_date", "n"), "d").alias("w")).select("party", F.col("w.filing_date").alias("window_start"), F.col("w.n").alias("n"))


def _burst(filings: DataFrame, days: int, least: int, high: int) -> tuple[DataFrame, DataFrame]:
    parties = party_filings(filings)
    found = burst_windows(parties, days=days, least=least)
    inside = parties.join(found, "party").where((F.col("filing_date") >= F.col("window_start")) & (F.col("filing_date") <= F.date_add("window_start", days)))
    text = F.format_string(fixed.BURST_TEXT, "party", "n", F.lit(days), F.col("window_start").cast("string"))
    severity, sure = F.when(F.col("n") < high, "medium").otherwise("high"), F.least(F.lit(0.95), F.lit(0.6) + (F.col("n") - 6) * F.lit(0.05))
    rows = found.withColumn("key", F.col("party"))
    return rows.select(*_indicator("burst_filing", severity, text, sure, party=F.col("party"), window_start=F.col("window_start"))), _links("burst_filing", "party", inside)


def burst_filing(filings: DataFrame, *, days: int = 30, least: int = 6, high: int = 10, evidence: int = EVIDENCE) -> DataFrame:
    return _with_evidence(*_burst(filings, days, least, high), evidence)


def identifier_links(filings: DataFrame, pattern: str, group: int = 1) -> DataFrame:
    """(identifier, source_id): each identifier once per source that holds it."""
    return filings.select("source_id", F.explode(F.array_distinct(all_matches("content", pattern, group))).alias("identifier")).distinct()


def shared_identifiers(filings: DataFrame, pattern: str, least: int, *, group: int = 1, most: int = EVIDENCE) -> DataFrame:
    """(identifier, n, cases): identifiers found in more than `least` sources, and the first `most` of these."""
    links = identifier_links(filings, pattern, group)
    n = links.groupBy("identifier").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least)
    first = Window.partitionBy("identifier").orderBy("source_id")
    few = links.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= most)
    return n.join(few.groupBy("identifier").agg(F.array_sort(F.collect_list("source_id")).alias("cases")), "identifier")


def _reused(filings: DataFrame, pattern: str, over: int, kind: str, severity: str, said: str, sure: float, group: int = 1) -> tuple[DataFrame, DataFrame]:
    links = identifier_links(filings, pattern, group)
    links = links.withColumn("identifier", F.lower("identifier")) if kind == "address" else links
    links = links.distinct() if kind == "address" else links
    n = links.groupBy("identifier").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > over).withColumn("key", F.concat_ws(":", F.lit(kind), "identifier"))
    rows = n.select(*_indicator("identity_reuse", F.lit(severity), F.format_string(said, "identifier", "n"), F.lit(sure), identifier_type=F.lit(kind)))
    return rows, _links("identity_reuse", F.concat_ws(":", F.lit(kind), "identifier"), links)


def identity_reuse(filings: DataFrame, *, ssn_over: int = 2, birth_over: int = 3, evidence: int = EVIDENCE) -> DataFrame:
    """Number fragments and dates of birth that recur across sources."""
    a = _with_evidence(*_reused(filings, fixed.SSN, ssn_over, "ssn_fragment", "high", fixed.SSN_TEXT, 0.75), evidence)
    return a.unionByName(_with_evidence(*_reused(filings, fixed.BIRTH, birth_over, "dob", "medium", fixed.BIRTH_TEXT, 0.55), evidence))


def shared_addresses(filings: DataFrame, *, over: int = 1, most: int = EVIDENCE) -> DataFrame:
    """(identifier, n, cases): street addresses, in lower case, in more than `over` sources."""
    return shared_identifiers(filings.withColumn("content", F.lower("content")), fixed.ADDRESS, over, group=0, most=most)


def _one(kind: str, hit: DataFrame, least: int, make) -> tuple[DataFrame, DataFrame]:
    """An indicator over all matching filings: one row of counts."""
    n = hit.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).withColumn("key", F.lit("all"))
    return n.select(*make), _links(kind, F.lit("all"), hit.select("source_id").distinct())


def _deeds(filings: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    hit = filings.where(F.col("content").rlike(fixed.QUITCLAIM) & F.col("content").rlike(fixed.NOMINAL))
    made = _indicator("deed_fraud_pattern", F.lit("high"), F.format_string(fixed.DEED_TEXT, "n"), F.lit(0.80), deed_type=F.lit("quitclaim"), consideration=F.lit("nominal"))
    return _one("deed_fraud_pattern", hit, least, made)


def deed_pattern(filings: DataFrame, *, least: int = 3, evidence: int = EVIDENCE) -> DataFrame:
    return _with_evidence(*_deeds(filings, least), evidence)


def _entities(filings: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    hit = filings.where(F.exists("parties", lambda p: p.rlike(fixed.NUMBERED_ENTITY)))
    made = _indicator("suspicious_entity", F.lit("medium"), F.format_string(fixed.ENTITY_TEXT, "n"), F.lit(0.50), pattern=F.lit("numeric_entity_name"))
    return _one("suspicious_entity", hit, least, made)


def suspicious_entities(filings: DataFrame, *, least: int = 2, evidence: int = EVIDENCE) -> DataFrame:
    return _with_evidence(*_entities(filings, least), evidence)


def transfers(filings: DataFrame) -> DataFrame:
    """(address, filing_date, source_id): one row per address that a dated filing names."""
    return filings.where("filing_date is not null").select(F.explode(F.transform(all_matches("content", fixed.TRANSFER_ADDRESS, 1), F.lower)).alias("address"), "filing_date", "source_id")


def rapid_addresses(moves: DataFrame, *, least: int = 3, days: int = 90) -> DataFrame:
    """(address, n, span): addresses with at least `least` sources within `days`. moves: as of transfers."""
    rows = moves.groupBy("address").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source_id").alias("sources"), F.datediff(F.max("filing_date"), F.min("filing_date")).alias("span"))
    return rows.where((F.col("sources") >= least) & (F.col("span") <= days)).select("address", "n", "span")


def _transfers(filings: DataFrame, least: int, days: int) -> tuple[DataFrame, DataFrame]:
    moves = transfers(filings)
    rows = rapid_addresses(moves, least=least, days=days).withColumn("key", F.col("address"))
    made = _indicator("rapid_ownership_transfer", F.lit("high"), F.format_string(fixed.TRANSFER_TEXT, "address", "n", "span"), F.lit(0.70), address=F.col("address"), span_days=F.col("span"))
    return rows.select(*made), _links("rapid_ownership_transfer", "address", moves)


def rapid_transfer(filings: DataFrame, *, least: int = 3, days: int = 90, evidence: int = EVIDENCE) -> DataFrame:
    return _with_evidence(*_transfers(filings, least, days), evidence)


def indicators(filings: DataFrame, *, evidence: int = EVIDENCE) -> DataFrame:
    out = burst_filing(filings, evidence=evidence)
    for detector in (identity_reuse, deed_pattern, suspicious_entities, rapid_transfer):
        out = out.unionByName(detector(filings, evidence=evidence))
    return out


def evidence_links(filings: DataFrame) -> DataFrame:
    """(indicator_type, key, at, source_id): every source of every indicator, as rows."""
    out = None
    for found, links in (_burst(filings, 30, 6, 10), _reused(filings, fixed.SSN, 2, "ssn_fragment", "high", fixed.SSN_TEXT, 0.75), _reused(filings, fixed.BIRTH, 3, "dob", "medium", fixed.BIRTH_TEXT, 0.55), _deeds(filings, 3), _entities(filings, 2), _transfers(filings, 3, 90)):
        real = links.join(found.select(*_KEY), list(_KEY), "left_semi")
        out = real if out is None else out.unionByName(real)
    return out


def risk_level(found: DataFrame, *by: str) -> DataFrame:
    """(by, risk): none, low, medium, high or critical from the severities."""
    worst = F.count_if(F.col("severity") == "critical")
    high, medium, n = F.count_if(F.col("severity") == "high"), F.count_if(F.col("severity") == "medium"), F.count(F.lit(1))
    rolled = found.groupBy(*by).agg(high.alias("h"), medium.alias("m"), n.alias("n"), worst.alias("c"))
    risk = F.when(F.col("n") == 0, "none").when((F.col("c") > 0) | (F.col("h") >= 2) | ((F.col("h") >= 1) & (F.col("n") >= 3)), "critical").when((F.col("h") >= 1) | (F.col("m") >= 2), "high").when(F.col("m") >= 1, "medium").otherwise("low")
    return rolled.select(*by, risk.alias("risk"))


def all_evidence(found: DataFrame) -> DataFrame:
    """(evidence): the distinct sources behind all indicators, one a row."""
    return found.select(F.explode("evidence").alias("evidence")).distinct()


def displayed(found: DataFrame) -> DataFrame:
    """Indicators as shown: label in words, confidence in per cent, head of the first source id."""
    return found.select(F.initcap(F.replace("indicator_type", F.lit("_"), F.lit(" "))).alias("label"), F.upper("severity").alias("severity"), F.format_string("%.0f%%", F.col("confidence") * 100).alias("confidence"), F.left(F.get("evidence", F.lit(0)), F.lit(8)).alias("first_source"))
