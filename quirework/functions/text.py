"""Scalar functions on text, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind, for Java's regular expressions.
BLANK = r"(?U)\s+"

#: Forms of statutes, cases, proper names, amounts and dates, in the order in which entities are listed.
ENTITY_PATTERNS = (
    r"(?U)\b\d+\s+U\.?S\.?C\.?\s*§?\s*\d+(?:\([a-z]\))?\b",
    r"(?U)\b[A-Z]\w+\s+v\.\s+[A-Z]\w+\b",
    r"(?U)(?<!\.\s)\b(?:[A-Z][a-z]+\s){1,3}[A-Z][a-z]+\b",
    r"\$[\d,]+(?:\.\d{2})?",
    r"(?U)\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}\b",
)
#: Fixed value: a citation tag.
CITATION = r"\[chunk:([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})\]"


def words(text: Column) -> Column:
    """Runs of characters other than white space."""
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits: no stemming, no stop words."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def token_count(text: Column) -> Column:
    """Estimate of a model's tokens: 1.3 for each word, rounded down."""
    return F.floor(F.size(words(text)) * 13 / 10).cast("int")


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the terms, each padded by two blanks before and one after."""
    padded = F.transform(terms(text), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))))


def entities(text: Column) -> Column:
    """Distinct entities, pattern after pattern, each in order of appearance."""
    return F.array_distinct(F.concat(*(F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), lambda s: F.trim(s)) for p in ENTITY_PATTERNS)))


def sentences(text: Column) -> Column:
    """Sentences that end in a point before white space and a capital letter."""
    return F.filter(F.transform(F.split(text, r"(?<=\.)\s+(?=[A-Z])"), lambda s: F.trim(s)), lambda s: s != "")


def citations(text: Column) -> Column:
    """Ids of the chunks that a text cites, in order of appearance."""
    return F.regexp_extract_all(text, F.lit(CITATION), F.lit(1))


def without_citations(text: Column) -> Column:
    """The text without its citation tags."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s*\[chunk:[^\]]*\]", ""), r"\s+", " "))


def is_money(text: Column) -> Column:
    return F.trim(text).rlike(r"^\$?[\d,]+(\.\d{1,2})?$")


def needs_trigrams(query: Column) -> Column:
    """Whether a query has two capitalised words in a row or a section sign."""
    return query.rlike(r"[A-Z][a-z]+\s+[A-Z][a-z]+") | query.contains("§")
