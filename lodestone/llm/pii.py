"""Information-theoretic sanitisation, in DataFrame functions only.

Protected entities are found by expression: the base kinds (email, ip, card, phone) and secrets,
opaque runs of letters and digits such as keys and tokens. A term discloses an entity as far as
knowing the term tells that the entity is near. The corpus gives

    disclosure(c; t) = PMI(c; t) / IC(c) = log(p(c | t) / p(c)) / -log p(c)

with probabilities over documents, p(c | t) = n(c, t) / (n(t) + 1), so that a few chance meetings
prove little; n(c, t) counts the documents in which t stands within `reach` words of c. It nears 1
when the term never occurs away from the entity. Personal values are mostly unique and so have no
statistics of their own; the estimate backs off to their kind: c is each value and each kind. Terms
that meet c in at least `support` different texts and disclose it to at least `threshold` are
generalised: every occurrence in a document that holds c becomes a span of kind `term`.

Only documents that hold an entity are exploded into context terms; the document frequency of the
few terms that pass `support` is then counted over the whole corpus. A text with many spans costs
no more than in proportion to its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import BROADCAST_ROWS, join_checked, let, parts_of, scan, written

#: The base expressions. A local part begins where its run of characters begins or
#: where the previous match ended, and repeats are possessive, so that no text costs more than
#: linear time; the leftmost matches stay the same.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
TERM = r"[\p{L}]{3,}+"
#: A run of 20 characters or more in which letters and digits alternate often, unlike in words and numbers.
SECRET = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
ALTERNATION = 6
SPANS = "array<struct<start:int,order:int,end:int,kind:string,value:string>>"


def raw_spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches, in code points.

    split and regexp_extract_all see the same matches; the lengths of gaps and values add up.
    """
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"), F.split(text, pattern, -1).alias("gaps"))

    def placed(x: Column) -> Column:
        values = x["values"]
        sizes = F.zip_with(F.slice(x["gaps"], F.lit(1), F.size(values)), values, lambda g, v: (F.char_length(g) + F.char_length(v)).cast("long"))
        ends = scan(sizes, lambda a, b: a + b)
        return F.zip_with(ends, values, lambda e, v: F.struct((e - F.char_length(v)).cast("int").alias("start"), e.cast("int").alias("end"), v.alias("value")))

    return let(found, lambda x: F.when(F.size(x["values"]) > 0, placed(x)).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>")))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Sum of the digits from the right, every second one doubled, divisible by ten."""
    each = F.split(F.reverse(digits), "")
    def add(acc: Column, x: Column) -> Column:
        d = x["d"].cast("int")
        doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(x["i"] % 2 == 1, doubled).otherwise(d)
    placed = F.transform(F.filter(each, lambda d: d != ""), lambda d, i: F.struct(d.alias("d"), i.alias("i")))
    return F.aggregate(placed, F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> Column:
    """array<struct<start, end, kind, value>> by start, then kind as listed."""
    part = lambda v: F.forall(F.split(v, r"\."), lambda p: F.char_length(F.ltrim(p, F.lit("0"))).between(0, 3) & (F.coalesce(F.try_to_number(F.right(p, F.lit(3)), F.lit("999")), F.lit(0)) <= 255))
    between = lambda v, a, b: F.char_length(_digits(v)).between(a, b)
    keep = {"email": None, "ip": part, "card": lambda v: between(v, 12, 19) & _luhn(_digits(v)), "phone": lambda v: between(v, 9, 15)}
    # a text without the sign of a kind is not searched for it
    sign = {"email": text.contains("@"), "ip": text.rlike("[0-9]\\.[0-9]"), "card": text.rlike("[0-9][0-9 -]{10}"), "phone": text.contains("+")}
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    found = []
    for k, (kind, pattern) in enumerate(zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True)):
        spans = F.when(sign[kind], raw_spans(text, pattern)).otherwise(none)
        found.append(_tagged(_passing(spans, keep[kind]) if keep[kind] else spans, k, kind))
    return F.array_sort(F.concat(*found))


def _passing(spans: Column, test) -> Column:
    return F.filter(spans, lambda s: test(s["value"]))


def _tagged(spans: Column, order: int, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value")))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def with_base_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, spans): one row per row; null text is empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("spans", base_spans(F.col("text")))


def protected_spans(text: Column) -> Column:
    """The base spans and those of kind `secret`, by start, then kind."""
    opaque = lambda v: F.size(F.regexp_extract_all(v, F.lit("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])"), F.lit(0))) * ALTERNATION >= F.char_length(v)
    secrets = F.when(text.rlike(SECRET), _tagged(_passing(raw_spans(text, SECRET), opaque), len(KINDS), "secret")).otherwise(F.array().cast(SPANS))
    return F.array_sort(F.concat(base_spans(text), secrets))


def free_terms(text: Column, spans: Column) -> Column:
    """struct<all array<struct<start, end, value>>, upto array<long>>: the terms outside all spans, and how many of them start before each span.

    spans: sorted by start. A term that a span overlaps is none.
    """
    own = F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), F.lit(0).alias("is_term"), i.alias("i"), s["end"].alias("end"), F.lit("").alias("value")))
    terms = F.transform(raw_spans(text, TERM), lambda t: F.struct(t["start"].alias("start"), F.lit(1).alias("is_term"), F.lit(0).alias("i"), t["end"].alias("end"), t["value"].alias("value")))

    def marked(x: Column) -> Column:
        covered = scan(F.transform(x, lambda y: F.when(y["is_term"] == 0, y["end"]).otherwise(0).cast("long")), F.greatest)
        begun = lambda y, i: F.coalesce((F.get(x, i + 1)["is_term"] == 0) & (F.get(x, i + 1)["start"] < y["end"]), F.lit(False))
        free = F.transform(x, lambda y, i: (y["is_term"] == 1) & ~begun(y, i))
        free = F.zip_with(free, F.zip_with(x, covered, lambda y, c: y["start"] >= c), lambda a, b: a & b)
        return let(F.struct(x.alias("x"), free.alias("free")), counted)

    def counted(m: Column) -> Column:
        count = scan(F.transform(m["free"], lambda f: f.cast("long")), lambda a, b: a + b)
        kept = F.filter(F.zip_with(m["x"], m["free"], lambda y, f: F.struct(y["start"].alias("start"), y["end"].alias("end"), y["value"].alias("value"), f.alias("free"))), lambda y: y["free"])
        upto = F.filter(F.zip_with(m["x"], count, lambda y, n: F.struct((y["is_term"] == 0).alias("is_span"), n.alias("n"))), lambda y: y["is_span"])
        return F.struct(kept.alias("all"), F.transform(upto, lambda y: y["n"]).alias("upto"))

    return let(F.array_sort(F.concat(own, terms)), marked)


def contexts(found: DataFrame, reach: int) -> DataFrame:
    """(_row, copy, kind, value, terms): one row per span of found (_row, text, spans), with the terms within `reach` words of it.

    copy: the hash of the text. Words count whole, however far away in code points they are.
    """

    def each(x: Column) -> Column:
        first = lambda i: F.greatest(F.get(x["upto"], i) - reach, F.lit(0)).cast("int")
        near = lambda i: F.slice(x["all"], first(i) + 1, F.get(x["upto"], i).cast("int") + reach - first(i))
        terms = lambda i: F.array_distinct(F.transform(near(i), lambda t: F.lower(t["value"])))
        return F.transform(F.col("spans"), lambda s, i: F.struct(s["kind"].alias("kind"), s["value"].alias("value"), terms(i).alias("terms")))

    spans = F.explode(let(free_terms(F.col("text"), F.col("spans")), each)).alias("s")
    return found.select("_row", F.xxhash64("text").alias("copy"), spans).select("_row", "copy", "s.*")


def entities(near: DataFrame, *more: str) -> DataFrame:
    """(_row, entity, *more): each span's value, and its kind, as the entities of its row."""
    both = F.array(F.concat_ws(":", "kind", "value"), F.col("kind"))
    return near.select("_row", F.explode(both).alias("entity"), *more)


def document_frequency(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n_t): in how many rows of docs (text) each of the terms occurs as a word."""
    few = terms.limit(BROADCAST_ROWS + 1).count()
    if not few:
        return terms.select("term", F.lit(1).cast("long").alias("n_t"))
    said = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), F.lower))
    words = docs.select(F.explode(said).alias("term"))
    # few terms: the words are filtered where they are read; many: counted first, so that a frequent word is one row a task
    if few <= BROADCAST_ROWS:
        return words.join(F.broadcast(terms), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("n_t")).join(terms, "term", "left_semi")


def disclosing_terms(docs: DataFrame, near: DataFrame, *, threshold: float, support: int) -> DataFrame:
    """(entity, term, disclosure) over all rows of docs (text). near: as of contexts."""
    pairs = entities(near, "terms", "copy").select("entity", F.explode("terms").alias("term"), "_row", "copy").distinct()
    strong = pairs.groupBy("entity", "term", "copy").agg(F.count(F.lit(1)).alias("n")).groupBy("entity", "term").agg(F.sum("n").alias("n_ct"), F.count(F.lit(1)).alias("_texts"))
    strong = written(strong.where(F.col("_texts") >= support).drop("_texts"), "strong")
    entity = entities(near).distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_c"))
    freq = document_frequency(docs, strong.select("term").distinct())
    total = F.lit(float(max(docs.count(), 1)))
    ic = -F.log(F.col("n_c") / total)
    pmi = F.log(F.col("n_ct") * total / (F.col("n_c") * (F.col("n_t") + 1)))
    return strong.join(entity, "entity").join(freq, "term").where(F.col("n_c") < total).select("entity", "term", (pmi / ic).alias("disclosure")).where(F.col("disclosure") >= threshold)


def disclosing_in_rows(found: DataFrame, near: DataFrame, bad: DataFrame) -> DataFrame:
    """(_row, terms): the terms outside spans that disclose an entity which the row holds."""
    said = F.array_distinct(F.transform(free_terms(F.col("text"), F.col("spans"))["all"], lambda t: F.lower(t["value"])))
    said = found.select("_row", F.explode(said).alias("term"))
    told = join_checked(said, bad, "term", "inner").join(entities(near).distinct(), ["_row", "entity"], "left_semi")
    return told.groupBy("_row").agg(F.collect_set("term").alias("terms"))


def sanitise(docs: DataFrame, *, threshold: float = 0.8, support: int = 3, reach: int = 3, id_col: str = "doc_id", text_col: str = "text", keep: tuple | list = ()) -> DataFrame:
    """(doc_id, text, spans, clean, *keep): spans of base kinds, `secret` and `term`, and the text without them.

    Values become [KIND]; disclosing terms are generalised to [TERM]; where spans overlap, the text
    is cut at the first and the later one is merged into it. One row per row of docs, repeated rows,
    null ids and ties included; null and empty texts have no spans. An empty table gives no rows.
    Other columns are ignored; ids need not be unique. Rows that hold spans are written once.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), *keep).withColumn("spans", protected_spans(F.col("text")))
    held = rows.where(F.size("spans") > 0).withColumn("_row", F.concat_ws(":", "doc_id", F.xxhash64("text")))
    held = written(held, "spans")
    near = written(contexts(held, reach), "contexts")
    bad = written(disclosing_terms(docs.select(text.alias("text")), near, threshold=threshold, support=support), "disclosing")
    terms = written(disclosing_in_rows(held, near, bad), "terms")
    held = join_checked(held, terms, "_row", "left")
    said = F.filter(free_terms(F.col("text"), F.col("spans"))["all"], lambda w: F.array_contains("terms", F.lower(w["value"])))
    said = F.transform(said, lambda w: F.struct(w["start"].alias("start"), F.lit(len(KINDS) + 1).alias("order"), w["end"].alias("end"), F.lit("term").alias("kind"), F.lower(w["value"]).alias("value")))
    held = held.withColumn("spans", F.when(F.col("terms").isNull(), F.col("spans")).otherwise(F.array_sort(F.concat("spans", said))))
    held = held.withColumn("clean", replaced(F.col("text"), F.col("spans"))).select("doc_id", "text", "spans", "clean", *keep)
    none = F.array().cast(held.schema["spans"].dataType).alias("spans")
    return rows.where(F.size("spans") == 0).select("doc_id", "text", none, F.col("text").alias("clean"), *keep).unionByName(held)


def replaced(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets."""
    upto = scan(F.transform(spans, lambda s: s["end"].cast("long")), F.greatest)  # where the text before the next span is used up
    before = lambda ends, i: F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1)).cast("int")

    def gaps(ends: Column) -> Column:
        own = F.transform(spans, lambda s, i: F.struct(before(ends, i).alias("start"), F.greatest(s["start"], before(ends, i)).alias("end"), F.when(s["start"] >= before(ends, i), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit("")).alias("then")))
        rest = F.struct(F.element_at(ends, -1).cast("int").alias("start"), F.char_length(text).alias("end"), F.lit("").alias("then"))
        return F.concat(own, F.array(rest))

    rebuilt = lambda g: F.array_join(F.zip_with(parts_of(text, g), g, lambda p, x: F.concat(p, x["then"])), "")
    return F.when(F.size(spans) > 0, let(let(upto, gaps), rebuilt)).otherwise(text)


def digest(done: DataFrame) -> DataFrame:
    """Counts and digests of the spans; n_spans counts all of them."""
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return done.select("doc_id", *map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("secret"), count("term"), F.size("spans").cast("long").alias("n_spans"))
