"""Inventory rows to typed items: de-duplication, payloads, regions, positions, texts and compact forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.functions import grids
from docweft.functions.text import SPACE

HEX64 = "^[0-9A-Fa-f]{64}$"
INLINE_CHARS = 4000


def first_deliveries(items: DataFrame) -> DataFrame:
    """One row for each (document, source_id): the first by ordinal, delivery and row. Items without an id are dropped."""
    order = Window.partitionBy("document", "source_id").orderBy(F.col("ordinal").asc_nulls_last(), F.col("ingested_at").asc_nulls_last(), "row_id")
    return items.where("source_id IS NOT NULL").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def payload_type(kind: Column) -> Column:
    return F.when(kind == "table", "table").when(kind.isin("image", "media"), "asset").when(kind == "relationship", "relationship").when(kind == "shape_description", "description").when(kind == "text", "text").otherwise("generic")


def typed_payload(items: DataFrame) -> DataFrame:
    """Each item with its payload: a struct whose ``type`` says which members are filled, and ``error`` where the item
    is invalid (a table without rows, an asset without a SHA-256). Invalid items stay, with the error's code."""
    kind, kinds = F.col("kind"), payload_type(F.col("kind"))
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    only = lambda kind, value: F.when(kinds == kind, value)
    link = {c: only("relationship", empty(c)) for c in ("source_part", "relationship_id", "relationship_type", "target", "target_mode")}
    payload = F.struct(
        kinds.alias("type"), F.when(kinds.isin("text", "description"), empty("text")).alias("text"), only("table", grids.text_rows(F.col("rows"))).alias("rows"), F.when(kinds.isin("asset", "description"), empty("name")).alias("name"),
        only("asset", F.upper("sha256")).alias("sha256"), only("asset", F.upper("visual_sha256")).alias("visual_sha256"), only("asset", F.coalesce("bytes", F.lit(0))).alias("bytes"), only("asset", kind).alias("media_kind"),
        *(v.alias(k) for k, v in link.items()), only("description", empty("title")).alias("title"), only("description", empty("description")).alias("description"),
    )
    error = F.when((kinds == "table") & F.col("rows").isNull(), "INVENTORY_TABLE_INVALID").when((kinds == "asset") & ~F.coalesce(F.col("sha256").rlike(HEX64), F.lit(False)), "INVENTORY_ASSET_SHA_INVALID")
    error = F.when(F.coalesce(F.trim("location"), F.lit("")) == "", "INVENTORY_LOCATION_MISSING").otherwise(error)
    return items.withColumn("payload", payload).withColumn("error", error)


def _region_of(hint: Column) -> Column:
    low = F.lower(F.regexp_replace(F.coalesce(hint, F.lit("")), r"\\", "/"))
    return (
        F.when(low.contains("notesmasters/") | low.startswith("notes_master:"), "notes_master")
        .when(low.contains("notesslides/") | low.startswith("notes:"), "notes")
        .when(low.contains("slidemasters/") | low.startswith("slide_master:"), "slide_master")
        .when(low.contains("slidelayouts/") | low.startswith("slide_layout:"), "slide_layout")
        .when(low.startswith("slide:") | low.rlike(r"(?:^|/)slides/slide\d+\.xml(?:/|$)"), "slide")
    )


def region(location: Column, part: Column, source_part: Column, explicit: Column, explicit_first: bool = False) -> Column:
    """Region of a presentation's item: from the hints in their order, or the explicit region first."""
    hinted = F.coalesce(_region_of(location), _region_of(part), _region_of(source_part))
    named = F.when(F.trim(explicit) != "", F.trim(explicit))
    return F.coalesce(F.lower(named), hinted) if explicit_first else F.coalesce(hinted, named)


def position(location: Column, unit: str, known: Column) -> Column:
    """Number of the page or slide: as known, else from a location that holds ``unit:N``."""
    return F.coalesce(known, F.regexp_extract(F.coalesce(location, F.lit("")), rf"(?:^|/){unit}:(\d{{1,9}})(?:/|$)", 1).try_cast("int"))


def text_fields(items: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, field, text): every text of typed items with the path it stands at; empty texts are left out.

    ``items`` has a payload struct, a location and a map of attributes. Cells are counted from 0; attributes come in
    the order of their keys. The explosion is narrow, so it runs where the scan ran.
    """
    p = F.col("payload")
    pair = lambda field, text: F.struct(F.lit(field).alias("field"), text.alias("text"))
    none = F.array().cast("array<struct<field:string,text:string>>")
    cells = F.flatten(F.transform(grids.text_rows(p["rows"]), lambda r, i: F.transform(r, lambda c, j: F.struct(F.concat(F.lit("payload.rows["), i.cast("string"), F.lit("]["), j.cast("string"), F.lit("]")).alias("field"), c.alias("text")))))
    own = (
        F.when(p["type"] == "text", F.array(pair("payload.text", p["text"])))
        .when(p["type"] == "description", F.array(*(pair(f"payload.{k}", p[k]) for k in ("text", "name", "title", "description"))))
        .when(p["type"] == "table", cells)
        .when(p["type"] == "relationship", F.array(pair("payload.target", p["target"])))
        .when(p["type"] == "asset", F.array(pair("payload.name", p["name"])))
        .when(p["type"] == "generic", F.array(pair("payload.value", p["value_json"])))
        .otherwise(none)
    )
    named = F.transform(F.array_sort(F.map_keys("attributes")), lambda k: F.struct(F.concat(F.lit("attributes."), k).alias("field"), F.element_at("attributes", k).alias("text")))
    every = F.concat(F.coalesce(own, none), F.array(pair("location", F.col("location"))), F.coalesce(named, none))
    return items.select(*keys, F.explode(F.filter(every, lambda x: F.coalesce(x["text"], F.lit("")) != "")).alias("_f")).select(*keys, "_f.field", "_f.text")


def source_text(text: Column, rows: Column) -> Column:
    """The text of an item; a table's cells joined by tabs and newlines."""
    return F.when(rows.isNotNull(), grids.joined_text(rows)).otherwise(F.coalesce(text, F.lit("")))


def summary(kind: Column, text: Column) -> Column:
    """White space collapsed, 500 code points; a name for the kind where nothing is left."""
    short = F.substring(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " ")), 1, 500)
    return F.when(short == "", F.concat(kind, F.lit(" source item"))).otherwise(short)


def compact(items: DataFrame) -> DataFrame:
    """Items with ``summary``, ``inline_text`` (up to 4 000 code points), ``table_preview`` and ``inline_chars``, the
    length of these as canonical JSON."""
    text = F.coalesce("text", F.lit(""))
    table = F.when(F.col("rows").isNotNull(), grids.preview(F.col("rows")))
    rows = items.withColumn("summary", summary(F.col("kind"), F.col("text"))).withColumn("inline_text", F.when((text != "") & (F.length(text) <= INLINE_CHARS), text))
    rows = rows.withColumn("table_preview", F.when(F.length(F.to_json(table)) <= INLINE_CHARS, table))
    return rows.withColumn("inline_chars", F.length(F.to_json(F.struct("inline_text", "summary", "table_preview"))))


def location_label(location: Column) -> Column:
    """Where an item stands, for a reader: paragraph, then slide, then page."""
    found = lambda unit: F.regexp_extract(F.coalesce(location, F.lit("")), rf"{unit}:(\d+)", 1)
    return (
        F.when(found("paragraph") != "", F.concat(F.lit("paragraph "), found("paragraph")))
        .when(found("slide") != "", F.concat(F.lit("slide "), found("slide")))
        .when(found("page") != "", F.concat(F.lit("page "), found("page")))
        .otherwise("source")
    )


def line_items(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, text) of the non-blank lines of a text, numbered from 1 with the blank ones counted."""
    lines = documents.select(F.col(key), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\r\n|\r|\n")).alias("_i", "_line"))
    return lines.select(key, (F.col("_i") + 1).alias("line"), F.col("_line").alias("text")).where(F.col("text").rlike(r"[^\s\x{a0}\x{3000}]"))


def description_text(name: Column, title: Column, description: Column) -> Column:
    """Name, title and description joined by bars; null where all are blank."""
    joined = F.concat_ws(" | ", *(F.when(F.trim(c) != "", F.trim(c)) for c in (name, title, description)))
    return F.when(joined != "", joined)


def smallest_size(sizes: DataFrame, key: str) -> DataFrame:
    """Of several occurrences of an image the size with the least area; ties by width. Sizes must be positive."""
    area = F.struct((F.col("width") * F.col("height")).alias("area"), F.col("width"), F.col("height"))
    return sizes.where("width > 0 AND height > 0").groupBy(key).agg(F.min(area).alias("_s")).select(key, "_s.width", "_s.height")
