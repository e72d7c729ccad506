"""Column expressions shared by the operators; all of them stay in the JVM and in whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The domains of the index.
CLASS_KINDS = ("class", "struct", "interface", "protocol", "enum")
CONTAINER_KINDS = ("class", "struct", "protocol", "interface", "enum", "extension")
SYMBOL_KINDS = "function class interface type enum variable method struct protocol extension property constant impl namespace".split()
INTENTS = (
    "authentication authorization data_access data_model api_endpoint business_logic ui_component configuration error_handling logging testing utility integration"
).split()
DEPENDENCY_ORDER = {"service_usage": 0, "injection": 1, "member_call": 2, "call": 3, "type_reference": 4, "import": 9}
# Words that keyword search leaves out.
KEYWORD_STOPWORDS = "a an and bar by code config configuration file for how in is of or the to with".split()


def contains(column: Column, text: str, ignore_case: bool = False) -> Column:
    """``LIKE '%text%'``: % and _ in ``text`` keep their meaning as wildcards."""
    return (F.ilike if ignore_case else F.like)(column, F.lit(f"%{text}%"))


def under(path: Column, prefix: str) -> Column:
    """``LIKE 'prefix%'``; plain prefixes reach the Parquet scan as StringStartsWith."""
    return path.startswith(prefix) if not set(prefix) & set("%_\\") else F.like(path, F.lit(prefix + "%"))


def literal_pattern(term: str) -> str:
    """``%term%`` with wildcards escaped."""
    return "%" + "".join("\\" + ch if ch in "%_\\" else ch for ch in term) + "%"


def keyword_terms(text: str) -> list[str]:
    """Up to six distinct terms of at least three characters, stop words left out, in order."""
    import re

    terms = [t for t in re.split(r"[^a-z0-9_]+", text.lower()) if len(t) >= 3 and t not in KEYWORD_STOPWORDS]
    return list(dict.fromkeys(terms))[:6]


def keyword_terms_of(text: Column) -> Column:
    """The same terms for a column, as an array."""
    words = F.split(F.lower(text), r"[^a-z0-9_]+")
    kept = F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*KEYWORD_STOPWORDS))
    return F.slice(F.array_distinct(kept), 1, 6)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays in double precision; null if lengths differ, an element is NaN or null, or a norm is 0."""
    x, y = a.cast("array<double>"), b.cast("array<double>")

    def total(p: Column, q: Column) -> Column:
        return F.aggregate(F.zip_with(p, q, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(total(x, x)) * F.sqrt(total(y, y))
    value = F.try_divide(total(x, y), F.nullif(norm, F.lit(0.0)))
    return F.when((F.size(a) == F.size(b)) & ~F.isnan(value), value)


def directory(path: Column) -> Column:
    """The folder of a path, '.' for files at the root."""
    cut = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(path.contains("/"), cut).otherwise(F.lit("."))


def joined(values: Column) -> Column:
    """A set of strings as one string, sorted, separated by commas; null for none."""
    kept = F.sort_array(F.array_distinct(F.filter(values, lambda v: v.isNotNull())))
    return F.when(F.size(kept) > 0, F.array_join(kept, ","))


def escaped_html(text: Column) -> Column:
    """Text that stands for itself in HTML: & < > and both quotes as entities; null stays null."""
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


def iso_time(time: Column) -> Column:
    """A timestamp in ISO form in UTC, to the millisecond; null stays null."""
    return F.concat(F.date_format(F.to_utc_timestamp(time, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))


def date_only(time: Column) -> Column:
    """The day of a timestamp."""
    return F.date_format(time, "yyyy-MM-dd")
