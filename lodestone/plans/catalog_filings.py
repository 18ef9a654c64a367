"""Queries of the filing detectors, over filings made from the orders table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import fixed
from lodestone.operators import filings
from lodestone.plans import search
from lodestone.plans.registry import literal, query, table

_DAY = "date_diff('day', DATE '1970-01-01', o_orderdate::DATE)"
#: Each order is a filing: a party of 97 or a numbered entity, number fragments and dates of birth of its customer, an address, every 89th a deed.
_FILED = f"""f AS (SELECT o_orderkey::VARCHAR AS source_id, o_orderdate::DATE AS filing_date, CASE WHEN o_custkey % 53 = 0 THEN 'entity ' || o_custkey ELSE 'party ' || (o_custkey % 97) END AS party,
CASE WHEN o_orderkey % 7 = 0 THEN lpad((o_custkey % 10000)::VARCHAR, 4, '0') END AS ssn, CASE WHEN o_orderkey % 5 = 0 THEN '1/' || (o_custkey % 28 + 1) || '/' || (1930 + o_custkey % 60) END AS born, o_orderkey % 89 = 0 AS deed,
CASE WHEN o_orderkey % 11 = 0 THEN (1000 + o_custkey % 5000)::VARCHAR || ' oak street' ELSE (1000 + {_DAY} // 30)::VARCHAR || ' main street' END AS address, o_custkey % 53 = 0 AS entity FROM orders)"""


def filed(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    key, who = F.col("o_orderkey"), F.col("o_custkey")
    party = F.when(who % 53 == 0, F.concat(F.lit("Entity "), who)).otherwise(F.concat(F.lit("Party "), who % 97))
    ssn = F.when(key % 7 == 0, F.concat(F.lit(" XXX-XX-"), F.lpad((who % 10000).cast("string"), 4, "0"))).otherwise("")
    born = F.when(key % 5 == 0, F.concat(F.lit(" DOB: 1/"), (who % 28 + 1).cast("string"), F.lit("/"), (1930 + who % 60).cast("string"))).otherwise("")
    deed = F.when(key % 89 == 0, " a quitclaim deed for the sum of $1.00").otherwise("")
    block = F.floor(F.unix_date("day") / 30)
    at = F.when(key % 11 == 0, F.concat((1000 + who % 5000).cast("string"), F.lit(" Oak Street"))).otherwise(F.concat((1000 + block).cast("string"), F.lit(" Main Street")))
    content = F.concat(F.lit("Filing"), ssn, born, deed, F.lit(" at "), at, F.lit(", Indianapolis"))
    return o.select(key.cast("string").alias("source_id"), content.alias("content"), F.array(party).alias("parties"), F.col("day").alias("filing_date"))


_FOUND = f"""{_FILED},
d AS (SELECT party, filing_date AS d, count(*) AS c FROM f GROUP BY 1, 2), w AS (SELECT party, d, sum(c) OVER (PARTITION BY party ORDER BY d RANGE BETWEEN CURRENT ROW AND INTERVAL 30 DAYS FOLLOWING) AS n FROM d),
b AS (SELECT party, min(d) AS ws, arg_min(n, d) AS n FROM w WHERE n >= 6 GROUP BY party),
found AS (
SELECT 'burst_filing' AS indicator_type, CASE WHEN n < 10 THEN 'medium' ELSE 'high' END AS severity, least(0.95, 0.6 + (n - 6) * 0.05) AS confidence, n AS n_evidence, printf({literal(fixed.BURST_TEXT)}, party, n::BIGINT, 30, ws::VARCHAR) AS description,
(SELECT arg_min(source_id, (filing_date, source_id)) FROM f WHERE f.party = b.party AND filing_date BETWEEN ws AND ws + 30) AS first_source FROM b
UNION ALL SELECT 'identity_reuse', 'high', 0.75, count(DISTINCT source_id), printf({literal(fixed.SSN_TEXT)}, ssn, count(DISTINCT source_id)), min(source_id) FROM f WHERE ssn IS NOT NULL GROUP BY ssn HAVING count(DISTINCT source_id) > 2
UNION ALL SELECT 'identity_reuse', 'medium', 0.55, count(DISTINCT source_id), printf({literal(fixed.BIRTH_TEXT)}, born, count(DISTINCT source_id)), min(source_id) FROM f WHERE born IS NOT NULL GROUP BY born HAVING count(DISTINCT source_id) > 3
UNION ALL SELECT 'deed_fraud_pattern', 'high', 0.80, count(*), printf({literal(fixed.DEED_TEXT)}, count(*)), min(source_id) FROM f WHERE deed HAVING count(*) >= 3
UNION ALL SELECT 'suspicious_entity', 'medium', 0.50, count(*), printf({literal(fixed.ENTITY_TEXT)}, count(*)), min(source_id) FROM f WHERE entity HAVING count(*) >= 2
UNION ALL SELECT 'rapid_ownership_transfer', 'high', 0.70, count(*), printf({literal(fixed.TRANSFER_TEXT)}, address, count(*), date_diff('day', min(filing_date), max(filing_date))), arg_min(source_id, (filing_date, source_id)) FROM f GROUP BY address HAVING count(DISTINCT source_id) >= 3 AND date_diff('day', min(filing_date), max(filing_date)) <= 90)"""


@query(f"WITH {_FOUND} SELECT indicator_type, severity, round(confidence, 4)::DOUBLE AS confidence, n_evidence::BIGINT AS n_evidence, description, first_source FROM found")
def filing_indicators(spark, sf_dir):
    found, _ = search.analyze_filings(filed(spark, sf_dir))
    return found.select("indicator_type", "severity", F.bround("confidence", 4).alias("confidence"), "n_evidence", "description", F.get("evidence", F.lit(0)).alias("first_source"))


@query(f"WITH {_FOUND}, c AS (SELECT count(*) AS n, count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'high') AS h, count(*) FILTER (severity = 'medium') AS m FROM found) SELECT CASE WHEN n = 0 THEN 'none' WHEN c > 0 OR h >= 2 OR (h >= 1 AND n >= 3) THEN 'critical' WHEN h >= 1 OR m >= 2 THEN 'high' WHEN m >= 1 THEN 'medium' ELSE 'low' END AS risk FROM c")
def risk_rollup(spark, sf_dir):
    return search.analyze_filings(filed(spark, sf_dir))[1]


@query(f"""WITH {_FOUND} SELECT 'burst_filing' AS indicator_type, b.party AS key, source_id FROM b JOIN f ON f.party = b.party AND filing_date BETWEEN ws AND ws + 30
UNION ALL SELECT DISTINCT 'identity_reuse', 'ssn_fragment:' || ssn, source_id FROM f WHERE ssn IN (SELECT ssn FROM f GROUP BY ssn HAVING count(DISTINCT source_id) > 2)
UNION ALL SELECT DISTINCT 'identity_reuse', 'dob:' || born, source_id FROM f WHERE born IN (SELECT born FROM f GROUP BY born HAVING count(DISTINCT source_id) > 3)
UNION ALL SELECT 'deed_fraud_pattern', 'all', source_id FROM f WHERE deed AND (SELECT count(*) FROM f WHERE deed) >= 3
UNION ALL SELECT 'suspicious_entity', 'all', source_id FROM f WHERE entity AND (SELECT count(*) FROM f WHERE entity) >= 2
UNION ALL SELECT 'rapid_ownership_transfer', address, source_id FROM f WHERE address IN (SELECT address FROM f GROUP BY address HAVING count(DISTINCT source_id) >= 3 AND date_diff('day', min(filing_date), max(filing_date)) <= 90)""")
def filing_evidence(spark, sf_dir):
    return filings.evidence_links(filed(spark, sf_dir)).select("indicator_type", "key", "source_id")


@query(f"WITH {_FOUND} SELECT DISTINCT source_id AS evidence FROM f WHERE deed AND (SELECT count(*) FROM f WHERE deed) >= 3")
def deed_evidence(spark, sf_dir):
    found = filings.evidence_links(filed(spark, sf_dir))
    return found.where("indicator_type = 'deed_fraud_pattern'").select(F.col("source_id").alias("evidence")).distinct()


_SHOWN = "upper(left(indicator_type, 1)) || substr(indicator_type, 2)"


@query(f"WITH {_FOUND} SELECT array_to_string(list_transform(string_split(indicator_type, '_'), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') AS label, upper(severity) AS severity, printf('%.0f%%', confidence::DOUBLE * 100) AS confidence, left(first_source, 8) AS first_source FROM found WHERE indicator_type <> 'burst_filing'")
def indicators_displayed(spark, sf_dir):
    found, _ = search.analyze_filings(filed(spark, sf_dir))
    return filings.displayed(found.where("indicator_type <> 'burst_filing'"))


@query(f"WITH {_FILED} SELECT address AS identifier, count(DISTINCT source_id) AS n, min(source_id) AS first_source FROM (SELECT source_id, (1000 + source_id::BIGINT % 700) || ' oak st' AS address FROM f WHERE source_id::BIGINT % 3 = 0) GROUP BY address HAVING count(DISTINCT source_id) > 1")
def shared_addresses(spark, sf_dir):
    key = F.col("source_id").cast("long")
    rows = filed(spark, sf_dir).where(key % 3 == 0).withColumn("content", F.concat(F.lit("Lives at "), (1000 + key % 700).cast("string"), F.when(key % 2 == 0, " Oak St").otherwise(" oak st"), F.lit(" now")))
    return filings.shared_addresses(rows).select("identifier", "n", F.get("cases", F.lit(0)).alias("first_source"))
