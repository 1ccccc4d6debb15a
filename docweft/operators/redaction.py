"""Literal redaction of reviewed terms, and what is wrong with redaction lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.functions.text import normalize_text


def redacted(text: Column, terms: Column) -> Column:
    """``text`` without any of the terms, applied in their order, normalised afterwards. Null terms are skipped."""
    gone = F.aggregate(F.coalesce(terms, F.array().cast("array<string>")), F.coalesce(text, F.lit("")), lambda acc, t: F.when(F.length(t) > 0, F.replace(acc, t, F.lit(""))).otherwise(acc))
    return normalize_text(gone)


def redaction_findings(entries: DataFrame, vocabulary: DataFrame, key: list[str]) -> DataFrame:
    """(*key, term, code): REDACTION_LIST_EMPTY, TERM_NOT_IN_VOCABULARY, TERM_NOT_IN_TEXT.

    ``entries`` has ``text`` and ``redactions``; the vocabulary one ``term`` a row, compared case aside.
    """
    empty = entries.where(F.coalesce(F.size("redactions"), F.lit(0)) <= 0).select(*key, F.lit(None).cast("string").alias("term"), F.lit("REDACTION_LIST_EMPTY").alias("code"))
    terms = entries.select(*key, "text", F.explode(F.array_distinct("redactions")).alias("term")).where("term IS NOT NULL")
    absent = terms.where(~F.coalesce(F.col("text"), F.lit("")).contains(F.col("term"))).select(*key, "term", F.lit("TERM_NOT_IN_TEXT").alias("code"))
    known = vocabulary.select(F.lower(F.trim(F.col("term"))).alias("_t")).distinct()
    unknown = terms.join(known, F.lower(F.trim(F.col("term"))) == F.col("_t"), "left_anti").select(*key, "term", F.lit("TERM_NOT_IN_VOCABULARY").alias("code"))
    return empty.unionByName(absent).unionByName(unknown)


def expected_text(action: Column, text: Column, reviewed: Column, terms: Column) -> Column:
    """The text that a decision lets through; null where it lets none."""
    return F.when(action == "preserve_exact", normalize_text(text)).when(action == "redact_identity", redacted(text, terms)).when(action == "reviewed_text", normalize_text(reviewed))
