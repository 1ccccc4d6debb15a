"""Template facts: fingerprints, differences, routing, similarity and the program's vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.functions.text import sha256_hex

# Operations a template program may use.
OPERATIONS = ("retain_part", "bind_slot", "bind_asset_role", "apply_style_ref", "repeat_block", "insert_text", "insert_image", "insert_table", "bind_header_footer", "section_break", "page_break", "validate_invariant")
FORBIDDEN_KEYS = ("code", "script", "python", "command", "shell", "eval", "exec")


def structure_fingerprint(parts: DataFrame, by: list[str], part: str = "part", digest: str = "sha256") -> DataFrame:
    """(*by, fingerprint): a digest over a package's parts in the order of their names, separated by NUL."""
    pairs = F.array_sort(F.collect_list(F.concat_ws("\x00", F.coalesce(F.col(part), F.lit("")), F.coalesce(F.col(digest), F.lit("")))))
    return parts.groupBy(*by).agg(sha256_hex(F.array_join(pairs, "\x00")).alias("fingerprint"))


def unpivoted(facts: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, name, value): one row for each fact."""
    return facts.select(key, F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in sorted(columns)))).alias("_f")).select(key, "_f.name", "_f.value")


def differences(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, name, status, expected, actual): PASS where both sides agree, nulls included, else FAIL."""
    a, b = expected.select(*keys, "name", F.col("value").alias("expected")), actual.select(*keys, "name", F.col("value").alias("actual"))
    return a.join(b, [*keys, "name"], "full_outer").withColumn("status", F.when(F.col("expected").eqNullSafe(F.col("actual")), "PASS").otherwise("FAIL"))


def route_matches(rules: Column, context: Column, when_unspecified: Column) -> Column:
    """Whether all rules hold in a context (a map): ``equals`` a value or ``in`` values; no rules leave it to the default,
    an unknown operator never holds."""
    holds = lambda r: F.coalesce(
        F.when(F.coalesce(r["operator"], F.lit("equals")) == "equals", F.element_at(context, r["field"]).eqNullSafe(r["value"])).when(r["operator"] == "in", F.array_contains(r["values"], F.element_at(context, r["field"]))), F.lit(False)
    )
    return F.when(F.coalesce(F.size(rules), F.lit(0)) <= 0, F.coalesce(when_unspecified, F.lit(False))).otherwise(F.forall(rules, holds))


def released(packs: DataFrame) -> DataFrame:
    """Packs that are released, approved, validated and without open findings."""
    return packs.where("lifecycle = 'released' AND approval_status = 'APPROVED' AND validation_status = 'PASS' AND coalesce(open_findings, 0) = 0")


def similar_templates(requested: DataFrame, packs: DataFrame) -> DataFrame:
    """(request, reference, score) of packs with the same structure or look: 1.0 for both, else 0.75.

    An OR of two equalities is two equality joins and a union, not a nested loop.
    """
    one = lambda c: requested.join(packs.select("reference", F.col(c).alias("_c")), F.col(c) == F.col("_c")).select("request", "reference", F.lit(c).alias("via"))
    both = one("structure_sha").unionByName(one("visual_sha"))
    return both.groupBy("request", "reference").agg(F.when(F.countDistinct("via") == 2, 1.0).otherwise(0.75).alias("score"))


def program_findings(operations: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, ordinal, code) of operations outside of the vocabulary or with a key that names code."""
    unknown = operations.where(~F.coalesce(F.col("op").isin(*OPERATIONS), F.lit(False))).select(*keys, "ordinal", F.lit("UNKNOWN_OPERATION").alias("code"))
    coded = operations.where(F.exists(F.map_keys("args"), lambda k: F.lower(k).isin(*FORBIDDEN_KEYS))).select(*keys, "ordinal", F.lit("FORBIDDEN_KEY").alias("code"))
    return unknown.unionByName(coded)


def slot_findings(material: DataFrame, slots: DataFrame, by: str) -> DataFrame:
    """(by, slot_id, items, code): required slots without material, more or fewer items than a slot takes, unknown slots."""
    have = material.groupBy(by, "slot_id").agg(F.count("*").alias("items"))
    rows = slots.join(have, [by, "slot_id"], "full_outer").withColumn("items", F.coalesce("items", F.lit(0)))
    code = F.when(F.col("kind").isNull(), "UNKNOWN_SLOT").when(F.col("required") & (F.col("items") == 0), "REQUIRED_SLOT_EMPTY").when(F.col("items") > F.col("max_items"), "TOO_MANY_ITEMS").when((F.col("items") > 0) & (F.col("items") < F.col("min_items")), "TOO_FEW_ITEMS")
    return rows.select(by, "slot_id", "items", code.alias("code")).where("code IS NOT NULL")


def media_references(media: DataFrame, relationships: DataFrame, by: str) -> DataFrame:
    """Media parts with the sorted ids of the relationships that point at them; none gives an empty text."""
    links = relationships.select(by, F.concat(F.lit("word/"), F.regexp_replace("target", r"^(?:\.\./|/)*", "")).alias("part"), "relationship_id")
    refs = links.groupBy(by, "part").agg(F.array_join(F.array_sort(F.collect_set("relationship_id")), ",").alias("relationship_ids"))
    return media.join(refs, [by, "part"], "left").withColumn("relationship_ids", F.coalesce("relationship_ids", F.lit("")))


def classify_regions(sections: DataFrame, by: str, order: str) -> DataFrame:
    """Sections with ``area``: a single one is the body; else the first is the cover, the last the closing."""
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy(by))
    at = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return sections.withColumn("area", F.when(n == 1, "body").when(at == 1, "cover").when(at == n, "closing").otherwise("body"))


def conservative_program(slots: DataFrame, parts: DataFrame, by: str) -> DataFrame:
    """(by, ordinal, op, target): a program that keeps every part and binds every slot by its kind, in a stable order."""
    from pyspark.sql import Window

    kept = parts.select(by, F.lit(0).alias("_g"), F.lit("retain_part").alias("op"), F.col("part").alias("target"))
    kind = F.when(F.col("kind") == "image", "insert_image").when(F.col("kind") == "table", "insert_table").otherwise("insert_text")
    bound = slots.select(by, F.lit(1).alias("_g"), kind.alias("op"), F.col("slot_id").alias("target"))
    order = Window.partitionBy(by).orderBy("_g", "target", "op")
    return kept.unionByName(bound).withColumn("ordinal", F.row_number().over(order)).select(by, "ordinal", "op", "target")


def package_limits(members: DataFrame, by: str, most_members: int = 10_000, most_bytes: int = 512 << 20) -> DataFrame:
    """(by, members, bytes, code) of packages beyond a limit, or with a member that may run code."""
    forbidden = F.lower("member").rlike(r"vbaproject\.bin$|(?:^|/)embeddings/|(?:^|/)activex/|afchunk")
    rows = members.groupBy(by).agg(F.count("*").alias("members"), F.sum("size").alias("bytes"), F.count_if(forbidden).alias("_f"))
    code = F.when(F.col("_f") > 0, "UNSUPPORTED_OBJECT").when(F.col("members") > most_members, "TOO_MANY_MEMBERS").when(F.col("bytes") > most_bytes, "TOO_MANY_BYTES")
    return rows.select(by, "members", "bytes", code.alias("code")).where("code IS NOT NULL")


def resolved(requests: DataFrame, catalog: DataFrame, request: str, by: list[str]) -> DataFrame:
    """(request, via, reference, status): a request is resolved by the first of the columns ``by`` that it states, and
    only if exactly one entry of the catalog has that value; else it is left to a human."""
    rows = requests.select(request, *by)
    for c in by:
        entries = catalog.where(F.col(c).isNotNull()).groupBy(F.col(c).alias(f"_v_{c}")).agg(F.count("*").alias(f"_n_{c}"), F.min("reference").alias(f"_r_{c}"))
        rows = rows.join(entries, F.col(c) == F.col(f"_v_{c}"), "left")
    first = F.coalesce(*(F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("via"), F.when(F.col(f"_n_{c}") == 1, F.col(f"_r_{c}")).alias("reference"))) for c in by))
    found = rows.select(request, first.alias("_f"))
    return found.select(request, "_f.via", "_f.reference", F.when(F.col("_f.reference").isNotNull(), "RESOLVED").otherwise("HUMAN_REVIEW").alias("status"))


# The operation that places an item of each kind.
PLACES = {"text": "insert_text", "image": "insert_image", "table": "insert_table"}


def filled_slots(material: DataFrame, slots: DataFrame, by: str, order: list[str]) -> DataFrame:
    """(by, slot_id, position, source_id, op): the program that places the material, for slots without a finding.

    ``material`` has kind, ``slots`` accepts. Items of a kind that the slot doesn't accept have no operation.
    """
    from pyspark.sql import Window

    bad = slot_findings(material, slots, by).select(by, "slot_id")
    rows = material.join(bad, [by, "slot_id"], "left_anti").join(slots.select(by, "slot_id", "accepts"), [by, "slot_id"])
    ops = F.create_map(*(F.lit(x) for pair in PLACES.items() for x in pair))
    rows = rows.withColumn("position", F.row_number().over(Window.partitionBy(by, "slot_id").orderBy(*order)))
    return rows.select(by, "slot_id", "position", "source_id", F.when(F.array_contains("accepts", F.col("kind")), F.try_element_at(ops, F.col("kind"))).alias("op"))


def part_relationships(relationships: DataFrame, by: str) -> DataFrame:
    """(by, part, relationship_ids): the sorted ids of the relationships that leave each part."""
    return relationships.where("source_part IS NOT NULL").groupBy(by, F.col("source_part").alias("part")).agg(F.array_join(F.array_sort(F.collect_set("relationship_id")), ",").alias("relationship_ids"))


def uniquely_named(entries: DataFrame, key: str, name: str) -> DataFrame:
    """(key, unique_name): whether a catalog entry is the only one of its name, case aside."""
    folded = entries.select(key, F.lower(name).alias("_name"))
    counts = folded.where("_name IS NOT NULL").groupBy("_name").agg(F.count("*").alias("_n"))
    return folded.join(counts, "_name", "left").select(key, F.coalesce(F.col("_n") == 1, F.lit(False)).alias("unique_name"))


def renumbered(drawings: DataFrame, by: str, order: list[str]) -> DataFrame:
    """``drawings`` with ``new_id``: a running number over all parts of a package."""
    from pyspark.sql import Window

    return drawings.withColumn("new_id", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
