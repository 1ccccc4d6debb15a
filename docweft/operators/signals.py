"""Signals in texts, reasons and status of items, and facts with their support."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweft.functions import grids, patterns
from docweft.functions.text import excerpt, prefixed_digest

# The reason that each signal gives (results must hold exactly these codes).
REASONS = {
    "email": "EMAIL_CANDIDATE", "url": "URL_CANDIDATE", "domain": "DOMAIN_CANDIDATE", "phone": "PHONE_CANDIDATE", "organization_name": "ORGANIZATION_NAME_CANDIDATE", "configured_identity_term": "CONFIGURED_IDENTITY_TERM_MATCH",
    "qr_candidate": "QR_CANDIDATE", "image": "IMAGE_ITEM", "repeated_asset": "REPEATED_ASSET_CANDIDATE", "obvious_table": "OBVIOUS_TABLE_ITEM", "obvious_text": "OBVIOUS_TEXT_ITEM", "ocr_text": "OCR_TEXT_ITEM",
    "external_relationship": "EXTERNAL_RELATIONSHIP_ITEM",
}


def text_signals(fields: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, field, type, value) of every match in ``text``; the patterns run in one projection over each text."""

    def tagged(name: str, pattern: str, group: int) -> Column:
        return F.transform(patterns.signal_values(F.col("text"), pattern, group), lambda v: F.struct(F.lit(name).alias("type"), v.alias("value")))

    found = [tagged(*signal) for signal in patterns.SIGNALS]
    return fields.select(*keys, "field", F.explode(F.concat(*found)).alias("_s")).select(*keys, "field", "_s.type", "_s.value")


def signal_offsets(fields: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, field, type, value, start, end, excerpt, signal_id): occurrences with code-point offsets.

    Each value's occurrences are found by splitting its text; a value that occurs n times gives n rows.
    """
    values = text_signals(fields, keys).distinct().join(fields.select(*keys, "field", "text"), [*keys, "field"])
    parts = F.split(F.col("text"), F.concat(F.lit(r"\Q"), F.col("value"), F.lit(r"\E")))
    ends = F.aggregate(parts, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + F.length(x) + F.when(F.size(acc) > 0, F.length("value")).otherwise(0))))
    rows = values.select(*keys, "field", "type", "value", "text", F.explode(F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0)))).alias("start"))
    rows = rows.withColumn("end", F.col("start") + F.length("value")).withColumn("excerpt", excerpt(F.col("text"), F.col("start"), F.col("end")))
    return rows.withColumn("signal_id", prefixed_digest("SIG", F.col("type"), F.col("field"), F.col("value"), F.col("start"), F.col("end"))).drop("text")


def asset_digest(items: DataFrame) -> DataFrame:
    """Items that are assets, with the digest they are compared by: of the picture, else of the bytes."""
    digest = F.upper(F.coalesce(F.when(F.col("visual_sha256") != "", F.col("visual_sha256")), F.when(F.col("sha256") != "", F.col("sha256"))))
    return items.where(F.col("kind").isin("image", "media")).withColumn("digest", digest).where("digest IS NOT NULL")


def repeated_assets(items: DataFrame, by: list[str]) -> DataFrame:
    """(*by, digest, occurrences) of assets that occur at least twice."""
    return asset_digest(items).groupBy(*by, "digest").agg(F.count("*").alias("occurrences")).where("occurrences >= 2")


def structural_signals(items: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, type, value): what an item's kind alone tells."""
    kind = F.col("kind")
    one = lambda name, value: F.struct(F.lit(name).alias("type"), value.alias("value"))
    none = F.lit(None).cast("struct<type:string,value:string>")
    table = F.concat(F.lit("rows="), F.size(grids.text_rows(F.col("rows"))).cast("string"), F.lit(";columns="), grids.width(F.col("rows")).cast("string"))
    text = kind.isin("text", "shape_description")
    qr = patterns.contains_any(F.lower(F.concat_ws(" ", "text", "name", "title", "description", "location", grids.joined_text(F.col("rows")))), patterns.QR_MARKERS)
    found = F.array(
        F.when(kind == "table", one("obvious_table", table)).otherwise(none), F.when(text, one("obvious_text", F.when(kind == "text", "text").otherwise("description"))).otherwise(none),
        F.when(text & (F.col("extraction") == "ocr"), one("ocr_text", F.lit("ocr"))).otherwise(none), F.when(kind.isin("image", "media"), one("image", kind)).otherwise(none),
        F.when(kind == "relationship", one("external_relationship", F.lit("relationship"))).otherwise(none), F.when(qr, one("qr_candidate", F.concat(F.lit("location="), F.coalesce("location", F.lit(""))))).otherwise(none),
    )
    return items.select(*keys, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("_s")).select(*keys, "_s.type", "_s.value")


def reasons(signals: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, reason_codes) sorted, from rows with a signal's type."""
    table = F.create_map(*(F.lit(x) for pair in REASONS.items() for x in pair))
    return signals.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(table[F.col("type")])), ",").alias("reason_codes"))


def reason_codes(items: DataFrame, keys: list[str], by: str) -> DataFrame:
    """(*keys, reason_codes) of items with any: what their kinds tell, and assets that repeat within ``by``.

    One pass over the items and one count per digest; ``keys`` name single items, so nothing is collected per key.
    """
    kind = F.col("kind")
    rows = items.select(*keys, by, "kind", "extraction", F.when(kind.isin("image", "media"), F.upper(F.coalesce(F.when(F.col("visual_sha256") != "", F.col("visual_sha256")), F.when(F.col("sha256") != "", F.col("sha256"))))).alias("_digest"))
    rows = rows.select(*dict.fromkeys([*keys, by]), "kind", "extraction", "_digest")
    often = rows.where("_digest IS NOT NULL").groupBy(by, "_digest").agg(F.count("*").alias("_n")).where("_n >= 2").select(F.col(by).alias("_by"), F.col("_digest").alias("_d"), F.lit(True).alias("_often"))
    # only assets meet the counts; the rest of a large group stays where it is
    assets = rows.where("_digest IS NOT NULL").join(often, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_digest") == F.col("_d")), "left").drop("_by", "_d")
    rows = assets.unionByName(rows.where("_digest IS NULL").withColumn("_often", F.lit(None).cast("boolean")))
    text = kind.isin("text", "shape_description")
    found = {"obvious_table": kind == "table", "obvious_text": text, "ocr_text": text & (F.col("extraction") == "ocr"), "image": kind.isin("image", "media"), "external_relationship": kind == "relationship", "repeated_asset": F.col("_often")}
    codes = F.array_sort(F.filter(F.array(*(F.when(yes, REASONS[name]) for name, yes in found.items())), lambda c: c.isNotNull()))
    return rows.select(*keys, F.array_join(codes, ",").alias("reason_codes")).where("reason_codes <> ''")


def identity_removals(items: DataFrame, terms: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, host, domain) of relationships whose host is, or ends with a dot and, a domain named by a term.

    A host is matched by its own suffixes, an equality join, so neither side is broadcast or crossed.
    """
    hosts = items.where("kind = 'relationship'").select(*keys, patterns.target_host(F.col("target")).alias("host")).where("host <> ''")
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, 1000), "."))
    domains = terms.select(patterns.term_domain(F.col("term")).alias("domain")).where("domain <> ''").distinct()
    return hosts.select(*keys, "host", F.explode(suffixes).alias("domain")).join(domains, "domain").select(*keys, "host", "domain")


def term_hits(parts: DataFrame, terms: DataFrame, keys: list[str], most_terms: int = 10_000) -> DataFrame:
    """(*keys, term, hits): how often each identity term occurs in each text, case aside, without overlaps.

    The terms are a reviewed list: one of more than ``most_terms`` is refused, so it may go to every worker. One
    automaton over all of them reads each text once, whatever their number; there is no join. Null texts and blank
    terms give no row.
    """
    words = [r.term for r in terms.select("term").where("term IS NOT NULL AND trim(term) <> ''").distinct().limit(most_terms + 1).collect()]
    if len(words) > most_terms:
        raise ValueError(f"more than {most_terms} identity terms")
    words.sort()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for n, word in enumerate(words):  # terms that differ only in case share a path
            folded = word.lower()
            automaton.add_word(folded, (*automaton.get(folded, ()), (n, len(folded))))
        automaton.make_automaton()
        for batch in batches:
            at, term, count = [], [], []
            for row, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                free: dict[int, int] = {}
                hits: dict[int, int] = {}
                for end, found in automaton.iter(text.lower()):
                    for n, size in found:
                        if end - size + 1 >= free.get(n, 0):
                            free[n] = end + 1
                            hits[n] = hits.get(n, 0) + 1
                for n, times in sorted(hits.items()):
                    at.append(row)
                    term.append(words[n])
                    count.append(times)
            kept = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns[:-1], pa.array(term, pa.string()), pa.array(count, pa.int32())], names=[*keys, "term", "hits"])

    rows = parts.select(*keys, F.col("text").alias("_text")).where("_text IS NOT NULL")
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("term", T.StringType()), T.StructField("hits", T.IntegerType())])
    return rows.mapInArrow(run, schema) if words else rows.where("false").select(*keys, F.lit("").alias("term"), F.lit(0).alias("hits"))


def facts(items: DataFrame, keys: list[str], text: str = "text", kinds: tuple[str, ...] = patterns.FACT_KINDS) -> DataFrame:
    """(*keys, kind, token, fact_key) of model numbers, measurements and certificates; only the patterns of ``kinds`` run."""
    rows = items.where(F.col(text).isNotNull()).select(*keys, F.explode(patterns.fact_tokens(F.col(text), kinds)).alias("_f"))
    return rows.select(*keys, F.col("_f.kind").alias("fact_kind"), F.col("_f.token").alias("token"), patterns.fact_key(F.col("_f.kind"), F.col("_f.token")).alias("fact_key"))


def unsupported_facts(claims: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """Facts of reviewed texts that neither their own source nor another cited one holds: an anti join on the key."""
    return claims.join(sources.select(*keys, "fact_kind", "fact_key").distinct(), [*keys, "fact_kind", "fact_key"], "left_anti")


def unsupported_counts(facts: DataFrame, claim: Column, keys: list[str]) -> DataFrame:
    """(*keys, fact_key, claims) of facts that only claims hold: one aggregation over both sides, without a join."""
    rows = facts.groupBy(*keys, "fact_kind", "fact_key").agg(F.count_if(claim).alias("claims"), F.count_if(~claim).alias("_held"))
    held = F.col("_held") > 0
    for key in keys:  # a null group holds nothing
        held = held & F.col(key).isNotNull()
    return rows.where((F.col("claims") > 0) & ~held).select(*keys, "fact_key", "claims")


def distinct_ignoring_case(rows: DataFrame, by: list[str], term: str, order: list[str]) -> DataFrame:
    """The first of the terms that differ only in case."""
    first = Window.partitionBy(*by, F.lower(F.trim(F.col(term)))).orderBy(*order)
    return rows.where(F.trim(F.col(term)) != "").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def identity_scan(parts: DataFrame, terms: DataFrame, approved: DataFrame, keys: list[str], strict: bool = True) -> DataFrame:
    """(*keys, term, hits, status): identity terms left in an output's parts. Approved terms are findings, too, unless
    ``strict`` is off; then their hits are marked APPROVED."""
    hits = term_hits(parts, terms, keys)
    known = approved.select(F.lower(F.trim(F.col("term"))).alias("_t")).distinct().withColumn("_ok", F.lit(True))
    rows = hits.join(known, F.lower(F.trim(F.col("term"))) == F.col("_t"), "left")
    return rows.select(*keys, "term", "hits", F.when(F.coalesce("_ok", F.lit(False)) & F.lit(not strict), "APPROVED").otherwise("FINDING").alias("status"))
