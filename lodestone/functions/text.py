"""Text, regex and hash functions as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import fixed


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _trimmed(x: Column) -> Column:
    return F.trim(x)  # F.trim itself would take the position as its second argument


def all_matches(text: str | Column, pattern: str, group: int = 0) -> Column:
    """Every match in order; null text gives an empty array."""
    return F.coalesce(F.regexp_extract_all(_c(text), F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def normalize_query(text: str | Column) -> Column:
    """White space collapsed, ends trimmed, closing punctuation removed."""
    return F.rtrim(F.trim(F.regexp_replace(_c(text), r"\s+", " ")), F.lit("?.,;:"))


def normalize_space(text: str | Column) -> Column:
    """Blank lines limited to one, runs of blanks and tabs to one blank."""
    lines = F.regexp_replace(_c(text), r"\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(lines, r"[ \t]+", " "), r"^\s+|\s+\z", "")


def strip_tags(text: str | Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(_c(text), r"<[^>]+>", " "), r"\s{2,}", " "))


def keywords(text: str | Column) -> Column:
    """Distinct lower-case words of three letters or more that are no stop words, first seen first."""
    words = F.transform(all_matches(text, r"(?U)\b[a-zA-Z]{3,}\b"), F.lower)
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(*fixed.STOPWORDS)))


def first_contained(text: Column, table: Mapping[str, str]) -> Column:
    """The value of the first key that the text contains."""
    chain = F.lit(None).cast("string")
    for key, value in reversed(table.items()):
        chain = F.when(text.contains(key), F.lit(value)).otherwise(chain)
    return chain


def jurisdiction(text: str | Column) -> Column:
    lower = F.lower(_c(text))
    state = F.lit(False)
    for sign in fixed.STATE_SIGNS:
        state = state | lower.contains(sign)
    return F.coalesce(first_contained(lower, fixed.COUNTIES), F.when(state, F.lit(fixed.STATE)))


def case_type(text: str | Column) -> Column:
    return first_contained(F.lower(_c(text)), fixed.CASE_TYPES)


def wants_current_law(text: str | Column) -> Column:
    lower, found = F.lower(_c(text)), F.lit(False)
    for sign in fixed.CURRENT_SIGNS:
        found = found | lower.contains(sign)
    return found


def statutes(text: str | Column) -> Column:
    return all_matches(text, "(?i)" + fixed.STATUTE)


def chunk_citations(text: str | Column) -> Column:
    return F.transform(all_matches(text, fixed.CHUNK_CITATION), _trimmed)


def classified(text: str | Column) -> Column:
    """struct<query_type, bm25_weight, authority_alpha>."""
    cites, asks = _c(text).rlike(fixed.LOOKUP_SIGN), _c(text).rlike(fixed.QUESTION_SIGN)
    kind = lambda name, w, a: F.struct(F.lit(name).alias("query_type"), F.lit(w).alias("bm25_weight"), F.lit(a).alias("authority_alpha"))
    return F.when(cites & ~asks, kind("citation_lookup", 0.70, 0.35)).when(asks & ~cites, kind("semantic", 0.30, 0.25)).otherwise(kind("hybrid", 0.50, 0.30))


def sentences(text: str | Column, *, before_capital: bool = True) -> Column:
    """Sentences, trimmed, empty ones dropped."""
    cut = r"(?<=[.!?])\s+(?=[A-Z])" if before_capital else r"(?<=[.!?])\s+"
    return F.filter(F.transform(F.split(_c(text), cut), _trimmed), lambda s: s != "")


def bm25_tokens(text: str | Column) -> Column:
    return F.filter(F.split(F.lower(_c(text)), r"(?U)\s+"), lambda t: t != "")


def token_estimate(text: str | Column) -> Column:
    return F.floor(F.char_length(_c(text)) / 4).cast("int")


def slug(text: str | Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(_c(text)), r"[^a-z0-9]+", "-"), F.lit("-"))


def chunk_key(text: str | Column, index: str | Column) -> Column:
    return F.concat(F.lit("ic-"), slug(text), F.lit("-"), F.lpad(_c(index).cast("string"), 3, "0"))


def safe_key(text: str | Column, *, names: bool = False) -> Column:
    """Only letters, digits and hyphens; names also keep dots and white space."""
    return F.regexp_replace(_c(text), r"[^A-Za-z0-9\-\.\s]" if names else r"[^A-Za-z0-9\-]", "")


def source_marks(text: str | Column) -> Column:
    return F.transform(all_matches(text, fixed.SOURCE_MARK, 1), _trimmed)


def uncited_claims(text: str | Column) -> Column:
    return F.filter(sentences(text, before_capital=False), lambda s: s.rlike(fixed.ASSERTION) & ~s.contains("[SOURCE:"))


def parties(text: str | Column) -> Column:
    return F.transform(all_matches(text, fixed.PARTY, 1), _trimmed)


def deadlines(text: str | Column) -> Column:
    return all_matches(text, fixed.DEADLINE)


def version_id(source: str | Column, content: str | Column) -> Column:
    return F.concat(_c(source).cast("string"), F.lit("@"), F.left(F.sha2(_c(content).cast("binary"), 256), F.lit(12)))


def edge_id(citing: str | Column, cited: str | Column) -> Column:
    return F.md5(F.concat_ws("->", _c(citing), _c(cited)))


def iso_date(text: str | Column) -> Column:
    """A date from the first ten characters (YYYY-MM-DD or YYYYMMDD); anything else is null."""
    head = F.left(_c(text).cast("string"), F.lit(10))
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.expr("try_cast(left({}, 10) as date)".format(text)) if isinstance(text, str) else head.try_cast("date")).when(
        _c(text).cast("string").rlike(r"^\d{8}$"), F.try_to_date(_c(text).cast("string"), "yyyyMMdd"))


def treatment(context: str | Column) -> Column:
    """struct<treatment, is_negative>: the longest label that the context names, negative ones first."""
    lower, chain = F.lower(_c(context)), F.struct(F.lit("cited").alias("treatment"), F.lit(False).alias("is_negative"))
    ranked = [(n, True) for n in sorted(fixed.NEGATIVE_TREATMENTS, key=lambda x: (-len(x), x))] + [(n, False) for n in sorted(fixed.POSITIVE_TREATMENTS, key=lambda x: (-len(x), x))]
    for name, bad in reversed(ranked):
        chain = F.when(lower.contains(name), F.struct(F.lit(name).alias("treatment"), F.lit(bad).alias("is_negative"))).otherwise(chain)
    return chain


def court_weight(court: str | Column) -> Column:
    """Authority of a court: exact name, else the longest name it contains, else the default."""
    lower = F.lower(F.trim(F.coalesce(_c(court), F.lit(""))))
    exact = chain = F.lit(fixed.COURT_DEFAULT)
    for name in sorted(fixed.COURT_WEIGHTS, key=lambda x: (len(x), x)):
        chain = F.when(lower.contains(name), F.lit(fixed.COURT_WEIGHTS[name])).otherwise(chain)
    exact = chain
    for name, weight in fixed.COURT_WEIGHTS.items():
        exact = F.when(lower == name, F.lit(weight)).otherwise(exact)
    return exact


def light_stem(word: Column) -> Column:
    """A small English suffix stemmer: plurals, -ed, -ing, -ly; words of four letters or fewer stay."""
    w = F.when(word.rlike("(?:sses|shes|ches|xes)$"), F.regexp_replace(word, "es$", "")).when(word.rlike("ies$"), F.regexp_replace(word, "ies$", "i")).when(word.rlike("[^su]s$"), F.regexp_replace(word, "s$", "")).otherwise(word)
    w = F.regexp_replace(w, "(?<=[a-z]{3})(?:ing|edly|ed|ly)$", "")
    return F.when(F.char_length(word) <= 4, word).otherwise(F.regexp_replace(w, "y$", "i"))


def section_headers(text: str | Column) -> Column:
    """array<string>: the header lines of sections, as the chunker finds them."""
    found = F.regexp_extract_all(text if isinstance(text, Column) else F.col(text), F.lit(fixed.SECTION), F.lit(0))
    return F.transform(found, lambda h: F.regexp_replace(h, r"^\s+|\s+$", ""))
