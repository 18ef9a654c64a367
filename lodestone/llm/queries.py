"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._common import arrow_rows, scratch_path, table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.warc import archive, digests, read_warc

    arrow_rows(spark, 200)
    path = scratch_path(spark, "warc")
    archive(table(spark, sf_dir, "pages"), path)
    found = digests(read_warc(spark, path))
    page = lambda c: F.when(F.col(c) != "null", F.col(c)).cast("long").alias(c)
    return found.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to"))


def op2_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.pii import digest, sanitise

    return digest(sanitise(table(spark, sf_dir, "documents")))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.decontaminate import contamination, digest

    arrow_rows(spark, 200)
    return digest(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10))


def op4_weak_supervision_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.toxicity import score_toxicity, train_toxicity

    arrow_rows(spark, 200)
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    fold = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)), F.lit(0))
    model = train_toxicity(docs, labels.where(fold != 0))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.html_extract import extract

    arrow_rows(spark, 200)
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op6_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.neardup import near_duplicate_classes

    arrow_rows(spark, 200)
    return near_duplicate_classes(table(spark, sf_dir, "documents"), threshold=0.8, width=5)


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.winnowing import compare_with_edit_and_next

    return compare_with_edit_and_next(table(spark, sf_dir, "documents"))


def op9_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.langid import identify, train_languages

    arrow_rows(spark, 200)
    docs = table(spark, sf_dir, "documents")
    fold = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)), F.lit(2))
    model = train_languages(docs.where(fold != 2).select("text", "lang"))
    found = identify(docs.select("doc_id", "text"), model)
    first = F.try_element_at("languages", F.lit(1))
    return found.select("doc_id", (fold == 2).alias("held_out"), F.coalesce(first["lang"], F.lit("und")).alias("lang_pred"), F.coalesce(first["share"], F.lit(0.0)).alias("score"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.chat import digest, formatted, linear_tree

    said = r"\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return digest(formatted(linear_tree(turns.unionByName(extra))))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lodestone.llm.packing import pack_documents

    arrow_rows(spark, 200)
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.runs import digest, looped, periodic_runs

    arrow_rows(spark, 200)
    docs = table(spark, sf_dir, "documents").select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text"))
    return digest(periodic_runs(docs))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm._common import written
    from lodestone.llm.vector_codes import encode, train_codebooks, with_label_error

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = train_codebooks(rows, parts=4, entries=256, rounds=4, scale=1024)
    if books is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = with_label_error(written(encode(rows, books), "codes"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.vector_dedup import near_links

    return near_links(table(spark, sf_dir, "embeddings"), threshold=0.95)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_NIBBLES = "[" + ", ".join(f"'{i:04b}'" for i in range(16)) + "]"
_BITS = f"array_to_string(list_transform(string_split(sha1(html), ''), lambda c: {_NIBBLES}[instr('0123456789abcdef', c)]), '')"
_FIVE = " + ".join(f"{16 >> k} * (substr(bits, 5 * i + {k + 1}, 1) = '1')::INT" for k in range(5))
_OP1 = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), b AS (SELECT page_id, strlen(html) AS payload_bytes, {_BITS} AS bits, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {_FIVE}, 1)), '') AS payload_digest,
CASE WHEN last = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN last <> page_id THEN last END AS refers_to FROM b"""

_OP3 = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id::VARCHAR AS item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
g AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM win))),
h AS (SELECT doc_id, item_id, i, n FROM g JOIN win USING (n, g)),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN s USING (doc_id)"""

_SAID = r"'\### Assistant: </turn> ok'"
_ESCAPED = "(length({0}) + length({0}) - length(replace(replace({0}, '\\', ''), '<', '')))"
_OP10 = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', {_SAID}), (-7, 1, 'assistant', {_SAID})))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
sum(15 + {_ESCAPED.format("role")} + length(role) - length(replace(role, '>', '')) + {_ESCAPED.format("text")})::BIGINT AS formatted_chars FROM c GROUP BY conv_id"""


_CRC32 = """list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
lambda crc, c: list_reduce(list_concat([xor(crc, c)], range(8)::UBIGINT[]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384)))"""
_OP11 = f"""WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, xor({_CRC32}, 4294967295::UBIGINT)::BIGINT AS h FROM documents),
e AS (SELECT *, len(w) AS n, (h // 10) % len(w) AS a, 1 + (len(w) - (h // 10) % len(w)) // (3 + (h // 10) % 8) AS p FROM t),
d AS MATERIALIZED (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_concat(w[:a], list_transform(range(0, n - a), lambda i: w[1 + a + i % p])) ELSE w END AS w FROM e),
g AS MATERIALIZED (SELECT doc_id, i, n, hash(array_to_string(w[i + 1 : i + 5], ' ')) AS g FROM (SELECT *, unnest(range(0, n - 4)) AS i FROM d WHERE n > 5)),
m AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM g a JOIN g b ON a.doc_id = b.doc_id AND a.g = b.g AND b.i > a.i AND b.i - a.i <= a.n // 4),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + 4 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM m) GROUP BY doc_id, q, k),
r AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM s WHERE length >= greatest(6, 4 * q) GROUP BY ALL),
x AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
k AS (SELECT doc_id, string_agg(v, ' ' ORDER BY i) AS kept FROM (SELECT doc_id, unnest(w) AS v, unnest(range(0, n)) AS i FROM d) ANTI JOIN x USING (doc_id, i) GROUP BY doc_id),
b AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs, arg_min({{'s': start, 'l': length, 'p': period}}, [-length / period, start, period]) AS best FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.p AS period, 1000 * best.l // best.p AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)"""

_OP12_ASSIGNED = """a{r} AS MATERIALIZED (SELECT vec_id, p, x, min(d * 256 + j) // 256 AS d, min(d * 256 + j) % 256 AS j
FROM (SELECT vec_id, v.p, x, j, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - b[i]) * (x[i] - b[i])))::BIGINT AS d FROM v JOIN b{r} USING (p)) GROUP BY ALL)"""
_OP12_REFINED = """b{s} AS MATERIALIZED (SELECT b{r}.p, b{r}.j, coalesce(m.b, b{r}.b) AS b FROM b{r} LEFT JOIN (SELECT p, j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS b
FROM (SELECT p, j, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT p, j, unnest(x) AS x, unnest(range(1, len(x) + 1)) AS i FROM a{r}) GROUP BY ALL) GROUP BY ALL) m USING (p, j))"""
_OP12 = f"""WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT vec_id, p, e[p * len(e) // 4 + 1 : (p + 1) * len(e) // 4] AS x FROM k, range(4) r(p)),
b0 AS MATERIALIZED (SELECT p, dense_rank() OVER (ORDER BY vec_id) - 1 AS j, x AS b FROM v WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 256)),
{", ".join(_OP12_ASSIGNED.format(r=r) + ", " + _OP12_REFINED.format(r=r, s=r + 1) for r in range(4))}, {_OP12_ASSIGNED.format(r=4)},
c AS (SELECT vec_id, string_agg(printf('%02x', j), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a4 GROUP BY vec_id),
s AS (SELECT sha256(string_agg(array_to_string(b, ','), ',' ORDER BY p, j)) AS codebooks_sha256 FROM b4)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM c JOIN k USING (vec_id), s"""


_OP13 = """WITH RECURSIVE u AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL
AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT vec_id, coalesce(n, 0) AS n_links, least AS component_id, vec_id = least AS kept FROM embeddings LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) ON a = vec_id
JOIN (SELECT a AS i, min(b) AS least FROM r GROUP BY a) ON i = vec_id"""


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    """Of the queries that SQL can express; the others are tested against brute force in tests/llm."""
    return {"op1_warc": _OP1, "op3_benchmark_decontamination": _OP3, "op10_chat_formatting": _OP10, "op11_periodic_runs": _OP11, "op12_vector_codes": _OP12, "op13_embedding_dedup": _OP13}
