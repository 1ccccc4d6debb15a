"""Decided content: aliases, blocks, sections, previews, expected outputs, and the relations of a review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.functions import patterns
from docweft.functions.text import normalize_text, prefixed_digest

CONTENT_ACTIONS = ("preserve_exact", "preserve_image", "preserve_sanitized_image", "redact_identity", "reviewed_text")
# Names that a file must not have on some systems.
RESERVED = "(?i)^(?:con|prn|aux|nul|com[1-9]|lpt[1-9])(?:\\..*)?$"


def agreed(*aliases: Column) -> tuple[Column, Column]:
    """(the one value that all given aliases name, whether they contradict each other); nulls and blanks don't count."""
    given = F.array_distinct(F.filter(F.array(*(F.trim(a) for a in aliases)), lambda a: a != ""))
    return F.when(F.size(given) == 1, F.get(given, 0)), F.size(given) > 1


def is_structural(kind: Column, region: Column, title: Column, description: Column) -> Column:
    """Items that only carry a presentation's structure: masters and layouts, and shapes nobody described."""
    bare = F.coalesce(F.trim(title), F.lit("")).eqNullSafe("") & F.coalesce(F.trim(description), F.lit("")).eqNullSafe("")
    return F.coalesce(region.isin("slide_master", "slide_layout", "notes_master"), F.lit(False)) | (F.coalesce(region.isin("slide", "notes"), F.lit(False)) & (kind == "shape_description") & bare)


def blocks(decisions: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, block_index, text, target_slot, target_order): one row for each reviewed block, one for a decision without.

    A block's own target goes before the decision's; blocks are counted from 0, decisions without blocks have null.
    """
    rows = decisions.select("*", F.posexplode_outer("reviewed_blocks").alias("block_index", "_b"))
    return rows.select(*keys, "block_index", F.coalesce("_b.text", "reviewed_text").alias("text"), F.coalesce("_b.target_slot", "target_slot").alias("target_slot"), F.coalesce("_b.target_order", "target_order").alias("target_order"))


def with_every(rows: DataFrame, dimension: DataFrame, columns: list[str], most: int = 1000) -> DataFrame:
    """Each row with every row of a small dimension, as an explosion of a literal; a longer dimension is refused."""
    found = dimension.select(*columns).distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a dimension of more than {most} rows")
    kind = dimension.select(*columns).schema
    values = F.array(*(F.struct(*(F.lit(r[c]).cast(kind[c].dataType).alias(c) for c in columns)) for r in found)) if found else F.array().cast(f"array<{kind.simpleString()}>")
    return rows.select("*", F.explode(values).alias("_d")).select(*rows.columns, *(f"_d.{c}" for c in columns))


def section_counts(decisions: DataFrame, sections: DataFrame, by: list[str], section: str) -> DataFrame:
    """(*by, section, n) for every section of the dimension, 0 where nothing is placed. ``by`` values come from the decisions."""
    placed = decisions.where(F.col("action").isin(*CONTENT_ACTIONS)).groupBy(*by, section).agg(F.count("*").alias("n"))
    every = with_every(decisions.select(*by).distinct(), sections, [section])
    return every.join(placed, [*by, section], "left").select(*by, section, F.coalesce("n", F.lit(0)).alias("n"))


def preview(items: DataFrame, sections: DataFrame, by: list[str], section: str, order: list[str], filler: str) -> DataFrame:
    """(*by, section, place, blocks): sections in template order, unknown ones sorted behind, empty ones with a filler."""
    grouped = items.groupBy(*by, section).agg(F.count("*").alias("blocks"))
    every = with_every(items.select(*by).distinct(), sections, [section, "place"])
    rows = every.join(grouped, [*by, section], "full_outer")
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("place").asc_nulls_last(), section))
    return rows.select(*by, section, place.alias("place"), F.coalesce("blocks", F.lit(0)).alias("blocks"), F.when(F.col("blocks").isNull(), filler).otherwise("").alias("filler"))


def missing_outputs(expected: DataFrame, output: DataFrame, by: list[str], value: str) -> DataFrame:
    """Expected normalised texts that an output doesn't hold, compared by hash so that long texts don't travel."""
    digest = F.sha2(normalize_text(F.col(value)), 256)
    want = expected.where(normalize_text(F.col(value)) != "").withColumn("_h", digest)
    return want.join(output.select(*by, digest.alias("_h")).distinct(), [*by, "_h"], "left_anti").drop("_h")


def is_safe_path(path: Column) -> Column:
    """Whether a path stays inside of its folder: relative, forward slashes, no empty, dot or reserved part, no drive."""
    p = F.coalesce(path, F.lit(""))
    parts = F.split(p, "/")
    good = F.forall(parts, lambda x: (x != "") & (x != ".") & (x != "..") & ~x.rlike(RESERVED) & ~x.rlike(r"[. ]$"))
    return (p != "") & ~p.rlike(r"^[A-Za-z]:|^[/\\]|\\|[\x00-\x1f]|://") & good


def is_fact_sensitive(text: Column, extraction: Column) -> Column:
    """Texts whose facts need a second look: recognised ones, and those that hold a measurement or certificate."""
    return F.coalesce(extraction == "ocr", F.lit(False)) | F.coalesce(text.rlike(patterns.NUMBER_UNIT) | text.rlike(patterns.CERTIFICATION), F.lit(False))


def parts_of_duplicates(rows: DataFrame, by: list[str], key: str, part: str) -> DataFrame:
    """(*by, key, n, parts) of ids that come more than once, with the sorted parts they stand in."""
    found = rows.where(F.col(key).isNotNull()).groupBy(*by, key).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(part)), ",").alias("parts"))
    return found.where("n > 1")


def fewer_than_template(template: DataFrame, document: DataFrame, key: str) -> DataFrame:
    """(key, required, present) of kinds that a document has less often than its template."""
    a, b = template.groupBy(key).agg(F.count("*").alias("required")), document.groupBy(key).agg(F.count("*").alias("present"))
    return a.join(b, key, "left").withColumn("present", F.coalesce("present", F.lit(0))).where("present < required")


def titles_out_of_order(rows: DataFrame, expected: DataFrame, by: str, order: str, title: str) -> DataFrame:
    """(by, title, code): expected titles that are missing, doubled, or stand before one that should precede them."""
    have = rows.groupBy(by, title).agg(F.count("*").alias("n"), F.min(order).alias("at"))
    every = with_every(rows.select(by).distinct(), expected, [title, "place"])
    seen = every.join(have, [by, title], "left")
    before = F.max("at").over(Window.partitionBy(by).orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    code = F.when(F.col("n").isNull(), "TITLE_MISSING").when(F.col("n") > 1, "TITLE_DOUBLED").when(F.col("at") < F.col("_before"), "TITLE_OUT_OF_ORDER")
    return seen.withColumn("_before", before).select(by, title, code.alias("code")).where("code IS NOT NULL")


def review_items(findings: DataFrame, by: list[str], code: str, source: str) -> DataFrame:
    """(*by, category, review_item_id, sources): one item to review for each code, with an id over its members."""
    rows = findings.groupBy(*by, F.col(code).alias("category")).agg(F.array_join(F.array_sort(F.collect_set(source)), ",").alias("_s"), F.countDistinct(source).alias("sources"))
    return rows.withColumn("review_item_id", prefixed_digest("REVIEW", *(F.col(c) for c in by), F.col("category"), F.col("_s"))).drop("_s")


def annotation_targets(rows: DataFrame, page: str, section: str, block: str) -> DataFrame:
    """Rows with ``target``: the 1-based path page/section/block they are addressed by."""
    p = F.col(page)
    s = F.dense_rank().over(Window.partitionBy(page).orderBy(F.col(section).asc_nulls_first()))
    b = F.row_number().over(Window.partitionBy(page, section).orderBy(block))
    return rows.withColumn("target", F.concat_ws("/", p.cast("string"), s.cast("string"), b.cast("string")))


def ordered_union(*findings: DataFrame) -> DataFrame:
    """Findings of independent checks in one table, each with the ordinal of its check: the order never depends on timing."""
    out = None
    for n, df in enumerate(findings):
        df = df.withColumn("check_ordinal", F.lit(n))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def conflicting_candidates(rows: DataFrame, key: str, path: str, valid: str) -> DataFrame:
    """(key, paths) of folded keys with more than one different valid path, case aside."""
    found = rows.where(F.col(valid)).groupBy(F.lower(key).alias(key)).agg(F.countDistinct(F.lower(path)).alias("paths"))
    return found.where("paths > 1")


def rebound(command: Column, flag: str, value: Column) -> Column:
    """A command (array) with the argument behind a flag replaced, or flag and value appended where it lacks the flag."""
    at = F.array_position(command, flag)
    return F.when(at > 0, F.concat(F.slice(command, 1, at), F.array(value), F.slice(command, at + 2, 1_000_000))).otherwise(F.concat(command, F.array(F.lit(flag), value)))


def next_versions(existing: DataFrame, wanted: DataFrame, stem: str) -> DataFrame:
    """(stem, name): the stem itself if it is free, else ``stem-vN`` with the next free number."""
    number = F.coalesce(F.regexp_extract("name", r"-v(\d{1,9})$", 1).try_cast("int"), F.lit(1))
    taken = existing.select(F.regexp_replace("name", r"-v\d{1,9}$", "").alias(stem), number.alias("_v")).groupBy(stem).agg(F.max("_v").alias("_v"))
    return wanted.select(stem).distinct().join(taken, stem, "left").select(stem, F.when(F.col("_v").isNull(), F.col(stem)).otherwise(F.concat(F.col(stem), F.lit("-v"), (F.col("_v") + 1).cast("string"))).alias("name"))


def output_evidence(items: DataFrame, by: str) -> DataFrame:
    """(by, texts, digests, looks): what an output holds: different normalised texts, media digests and pictures.

    Values are made distinct before they are counted, so no group's values are collected."""
    from docweft.functions.text import normalize_text

    clean = normalize_text(F.col("text"))
    kinds = F.array(F.struct(F.lit("texts").alias("k"), F.when(clean != "", clean).alias("v")), F.struct(F.lit("digests").alias("k"), F.upper("sha256").alias("v")), F.struct(F.lit("looks").alias("k"), F.upper("visual_sha256").alias("v")))
    values = items.select(by, F.explode(F.transform(kinds, lambda x: F.struct(x["k"].alias("k"), F.sha2(x["v"], 256).alias("v")))).alias("_x")).select(by, "_x.k", "_x.v").distinct()
    return values.groupBy(by).agg(*(F.count_if((F.col("k") == k) & F.col("v").isNotNull()).alias(k) for k in ("texts", "digests", "looks")))
