"""The queries of this subpackage: pN_... for problem N. Each takes (spark, folder) and reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docweft.llm import bpe, lookalikes, mixing, personal, quality, residue, scans, splitting, variants
from docweft.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Items whose payload comes out in more than one piece."""
    return splitting.oversized(table(spark, folder, "typed_item", "item_id", "payload"), ["item_id"], splitting.payload_content())


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All pieces of all payloads with a content."""
    return splitting.split_contents(table(spark, folder, "typed_item", "item_id", "payload"), ["item_id"], splitting.payload_content())


def _linked(spark: SparkSession, folder: str) -> DataFrame:
    names = variants.spellings(table(spark, folder, "identity_review", "manufacturer_terms"), table(spark, folder, "inventory_item", "text"))
    return variants.link_variants(names)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of different spellings of one organisation or person."""
    return variants.variant_pairs(_linked(spark, folder))


def p2_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Each spelling with its entity's central spelling."""
    return _linked(spark, folder).select("name", "person", "entity")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that hold leftovers of templates, filler, errors or script notices."""
    return residue.find_residue(table(spark, folder, "inventory_item", "row_id", "document", "kind", "text"))


def p3_kept(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of content that later stages keep."""
    return residue.without_residue(table(spark, folder, "inventory_item", "row_id", "document", "kind", "text")).select("row_id")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds of noise on scanned pages."""
    return scans.page_noise(table(spark, folder, "inventory_item", "row_id", "document", "location", "text"))


def p4_text(spark: SparkSession, folder: str) -> DataFrame:
    """Scanned pages as continuous paragraphs."""
    return scans.repaired_pages(table(spark, folder, "inventory_item", "row_id", "document", "location", "text")).select("row_id", "text")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of personal information."""
    return personal.find_personal(table(spark, folder, "inventory_item", "row_id", "kind", "text", "rows"))


def p5_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Texts and tables with placeholders for personal information."""
    return personal.redact(table(spark, folder, "inventory_item", "row_id", "kind", "text", "rows"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of a document that look the same but differ."""
    return lookalikes.lookalike_pairs(table(spark, folder, "inventory_item", "row_id", "document", "text"))


def p6_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """Every row's text in its consistent form."""
    return lookalikes.canonical_texts(table(spark, folder, "inventory_item", "row_id", "document", "text"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode_documents(table(spark, folder, "documents", "doc_id", "text"))


def _sized(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.sized(table(spark, folder, "documents", "doc_id", "text", "source"))


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of the mixture and how often each is used."""
    return mixing.mixture(_sized(spark, folder), table(spark, folder, "mix_target"))


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    """Requested and actual shares."""
    return mixing.mixture_report(_sized(spark, folder), table(spark, folder, "mix_target"))


def p9_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of every document."""
    return quality.document_statistics(table(spark, folder, "documents", "doc_id", "text"), quality.common_words(table(spark, folder, "common_word")))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that are in the main no prose."""
    return p9_statistics(spark, folder).where("form <> 'prose'").select("doc_id", "form")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_entities, p3_found, p3_kept, p4_found, p4_text, p5_found, p5_redacted, p6_found, p6_canonical, p7_ids, p8_mixture, p8_report, p9_found, p9_statistics)}

ORACLE_SQL: dict[str, str] = {
    "p1_found": """
        SELECT item_id FROM typed_item WHERE length(CASE
            WHEN payload.type IN ('text', 'description') THEN payload.text
            WHEN payload.type = 'generic' THEN payload.value_json
            WHEN payload.type = 'table' THEN array_to_string(list_transform(payload.rows, lambda r: coalesce(array_to_string(list_transform(r, lambda c: coalesce(c, '')), chr(9)), '')), chr(10))
        END) > 4000
    """,
}
