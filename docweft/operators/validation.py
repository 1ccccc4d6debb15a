"""Decision and receipt checks as findings, and JSON schemas compiled to columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.functions.dates import is_date_time

LOW_CONFIDENCE = 0.8


def decision_findings(decisions: DataFrame, keys: list[str], threshold: float = LOW_CONFIDENCE) -> DataFrame:
    """(*keys, code, severity): low or missing confidence asks for review; one outside of 0..1 fails."""
    c = F.col("confidence")
    code = F.when(c.isNull() | (c < 0) | (c > 1), "CONFIDENCE_INVALID").when(c < threshold, "LOW_CONFIDENCE")
    rows = decisions.select(*keys, code.alias("code")).where("code IS NOT NULL")
    return rows.withColumn("severity", F.when(F.col("code") == "LOW_CONFIDENCE", "REVIEW").otherwise("FAIL"))


def identity_contradictions(reviews: DataFrame, keys: list[str]) -> DataFrame:
    """Reviews that state no identity but list terms, or state one and list none."""
    filled = F.size(F.filter(F.coalesce("manufacturer_terms", F.array().cast("array<string>")), lambda t: F.trim(t) != ""))
    code = F.when((F.col("status") == "NO_SOURCE_IDENTITY_FOUND") & (filled > 0), "TERMS_WITHOUT_IDENTITY").when((F.col("status") == "VERIFIED") & (filled == 0), "IDENTITY_WITHOUT_TERMS")
    return reviews.select(*keys, code.alias("code")).where("code IS NOT NULL")


def receipt_findings(queue: DataFrame, receipt: DataFrame, keys: list[str], binding: list[str]) -> DataFrame:
    """(*keys, code): items without a decision, decisions on nothing, and bindings that no longer agree."""
    q, r = queue.select(*keys, *binding, F.lit(1).alias("_q")), receipt.select(*keys, *(F.col(b).alias(f"_r_{b}") for b in binding), F.lit(1).alias("_r"))
    stale = F.lit(False)
    for b in binding:
        stale = stale | ~F.col(b).eqNullSafe(F.col(f"_r_{b}"))
    code = F.when(F.col("_r").isNull(), "DECISION_MISSING").when(F.col("_q").isNull(), "DECISION_UNKNOWN_ITEM").when(stale, "RECEIPT_STALE")
    return q.join(r, keys, "full_outer").select(*keys, code.alias("code")).where("code IS NOT NULL")


def changed_fields(before: DataFrame, after: DataFrame, key: str, volatile: tuple[str, ...]) -> DataFrame:
    """(key, name, allowed): facts (name, value) that changed, and whether only volatile ones may."""
    a, b = before.select(key, "name", F.col("value").alias("_a"), F.lit(1).alias("_in")), after.select(key, "name", F.col("value").alias("_b"), F.lit(1).alias("_out"))
    rows = a.join(b, [key, "name"], "full_outer").where(~(F.col("_a").eqNullSafe(F.col("_b")) & F.col("_in").isNotNull() & F.col("_out").isNotNull()))
    return rows.select(key, "name", F.col("name").isin(*volatile).alias("allowed"))


TYPES = {"string": "string", "integer": "bigint", "number": "double", "boolean": "boolean"}


def resolved_schema(schema: object, root: dict, depth: int = 16) -> object:
    """``schema`` with its local references ("#/...") replaced; a schema that refers to itself ends in an error."""
    if isinstance(schema, list):
        return [resolved_schema(x, root, depth) for x in schema]
    if not isinstance(schema, dict):
        return schema
    if "$ref" in schema:
        if depth == 0 or not schema["$ref"].startswith("#/"):
            raise ValueError(f"unresolvable reference {schema['$ref']}")
        target: object = root
        for part in schema["$ref"][2:].split("/"):
            target = target[part.replace("~1", "/").replace("~0", "~")]
        return resolved_schema({**target, **{k: v for k, v in schema.items() if k != "$ref"}}, root, depth - 1)
    return {k: resolved_schema(v, root, depth) for k, v in schema.items() if k != "$defs"}


def schema_errors(value: Column, schema: dict, path: str = "$") -> Column:
    """Array of (path, keyword) where a typed column breaks a JSON schema, local references included."""
    return _schema_errors(value, resolved_schema(schema, schema), path)


def _schema_errors(value: Column, schema: dict, path: str) -> Column:
    """Understands const, enum, minLength, maxLength, pattern, minimum, maximum, required, properties, minItems,
    maxItems, uniqueItems, items, allOf, anyOf, oneOf, not, if/then/else and the format date-time, for structs, arrays and
    scalars; for maps also minProperties, maxProperties, patternProperties and additionalProperties. A null value only
    breaks ``required`` of its parent. Everything is a column expression, so it runs inside of the JVM.
    """
    none = F.array().cast("array<struct<path:string,keyword:string>>")
    one = lambda bad, keyword: F.when(F.coalesce(bad, F.lit(False)), F.array(F.struct(F.lit(path).alias("path"), F.lit(keyword).alias("keyword")))).otherwise(none)
    checks = []
    if "const" in schema:
        checks.append(one(value != F.lit(schema["const"]), "const"))
    if "enum" in schema:
        checks.append(one(~value.isin(*schema["enum"]), "enum"))
    if "minLength" in schema:
        checks.append(one(F.length(value) < schema["minLength"], "minLength"))
    if "maxLength" in schema:
        checks.append(one(F.length(value) > schema["maxLength"], "maxLength"))
    if "pattern" in schema:
        checks.append(one(~value.rlike(schema["pattern"]), "pattern"))
    if "minimum" in schema:
        checks.append(one(value < schema["minimum"], "minimum"))
    if "maximum" in schema:
        checks.append(one(value > schema["maximum"], "maximum"))
    if "minItems" in schema:
        checks.append(one(value.isNotNull() & (F.size(value) < schema["minItems"]), "minItems"))
    if "maxItems" in schema:
        checks.append(one(value.isNotNull() & (F.size(value) > schema["maxItems"]), "maxItems"))
    if schema.get("uniqueItems"):
        checks.append(one(F.size(F.array_distinct(value)) < F.size(value), "uniqueItems"))
    if "items" in schema:
        inner = lambda x: F.size(_schema_errors(x, schema["items"], f"{path}[]")) > 0
        checks.append(F.when(F.exists(value, inner), F.flatten(F.transform(value, lambda x: _schema_errors(x, schema["items"], f"{path}[]")))).otherwise(none))
    for name in schema.get("required", ()):
        checks.append(one(value.isNotNull() & value[name].isNull(), f"required:{name}"))
    for name, inner in schema.get("properties", {}).items():
        checks.append(_schema_errors(value[name], inner, f"{path}.{name}"))
    for inner in schema.get("allOf", ()):
        checks.append(_schema_errors(value, inner, path))
    for keyword, fits in (("anyOf", lambda n: n >= 1), ("oneOf", lambda n: n == 1)):
        if keyword in schema:
            passed = sum(((F.size(_schema_errors(value, inner, path)) == 0).cast("int") for inner in schema[keyword]), F.lit(0))
            checks.append(one(value.isNotNull() & ~fits(passed), keyword))
    if "not" in schema:
        checks.append(one(value.isNotNull() & (F.size(_schema_errors(value, schema["not"], path)) == 0), "not"))
    if "if" in schema:
        holds = F.size(_schema_errors(value, schema["if"], path)) == 0
        branch = lambda name: _schema_errors(value, schema[name], path) if name in schema else none
        checks.append(F.when(value.isNull(), none).when(holds, branch("then")).otherwise(branch("else")))
    if schema.get("format") == "date-time":
        checks.append(one(value.isNotNull() & ~is_date_time(value), "format"))
    if "minProperties" in schema:
        checks.append(one(value.isNotNull() & (F.size(F.map_keys(value)) < schema["minProperties"]), "minProperties"))
    if "maxProperties" in schema:
        checks.append(one(value.isNotNull() & (F.size(F.map_keys(value)) > schema["maxProperties"]), "maxProperties"))
    for pattern, inner in schema.get("patternProperties", {}).items():
        if inner:
            checks.append(F.flatten(F.transform(F.coalesce(F.map_values(F.map_filter(value, lambda k, _: k.rlike(pattern))), F.array()), lambda v: _schema_errors(v, inner, f"{path}/{pattern}"))))
    if schema.get("additionalProperties") is False and ("patternProperties" in schema or schema.get("mapOf")):
        known = "|".join([*schema.get("patternProperties", {}), *(f"^{re.escape(n)}$" for n in schema.get("properties", {}))])
        checks.append(one(value.isNotNull() & F.exists(F.map_keys(value), lambda k: ~k.rlike(known)), "additionalProperties"))
    return F.concat(*checks) if checks else none


def reviewed_text_findings(entries: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, code) of reviewed texts whose evidence doesn't hold: empty text, no reviewer, no cited evidence, the own
    source not among it, or evidence nobody knows. ``entries`` has reviewed_text, reviewer, source_id and evidence_sources."""
    filled = F.filter(F.coalesce("evidence_sources", F.array().cast("array<string>")), lambda e: e.isNotNull())
    checks = {
        "REVIEWED_TEXT_EMPTY": F.coalesce(F.trim("reviewed_text"), F.lit("")) == "", "REVIEWER_MISSING": F.coalesce(F.trim("reviewer"), F.lit("")) == "", "EVIDENCE_MISSING": F.size(filled) == 0, "OWN_SOURCE_NOT_CITED": (F.size(filled) > 0) & ~F.array_contains(filled, F.col("source_id")),
    }
    codes = F.filter(F.array(*(F.when(bad, code) for code, bad in checks.items())), lambda c: c.isNotNull())
    own = entries.select(*keys, F.explode(codes).alias("code"))
    cited = entries.select(*keys, F.explode(F.array_distinct(filled)).alias("_e"))
    unknown = cited.join(evidence.select(F.col("source_id").alias("_e")).distinct(), "_e", "left_anti").select(*keys, F.lit("EVIDENCE_UNKNOWN").alias("code")).distinct()
    return own.unionByName(unknown)


def replacement_findings(entries: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, code) of sanitized images: wrong kind, unsafe path, no digest or the original's, no review note."""
    from docweft.operators.content import is_safe_path

    sha = F.coalesce("replacement_sha256", F.lit(""))
    checks = {
        "REPLACEMENT_KIND_INVALID": F.col("kind") != "image", "REPLACEMENT_PATH_UNSAFE": ~is_safe_path(F.col("replacement_path")), "REPLACEMENT_HASH_INVALID": ~sha.rlike("^[0-9A-F]{64}$"), "REPLACEMENT_UNCHANGED": sha == F.upper(F.coalesce("sha256", F.lit("?"))), "REVIEW_NOTE_MISSING": F.coalesce(F.trim("review_note"), F.lit("")) == "",
    }
    return entries.select(*keys, F.explode(F.filter(F.array(*(F.when(bad, code) for code, bad in checks.items())), lambda c: c.isNotNull())).alias("code"))


def set_differences(stated: DataFrame, required: DataFrame, key: str) -> DataFrame:
    """(key, code) where two sets that must be equal differ: UNEXPECTED, MISSING, or STATED_TWICE."""
    twice = stated.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key, F.lit("STATED_TWICE").alias("code"))
    return coverage_codes(stated.select(key).distinct(), required.select(key).distinct(), key).unionByName(twice)


def coverage_codes(stated: DataFrame, required: DataFrame, key: str) -> DataFrame:
    extra = stated.join(required, key, "left_anti").select(key, F.lit("UNEXPECTED").alias("code"))
    return extra.unionByName(required.join(stated, key, "left_anti").select(key, F.lit("MISSING").alias("code")))


def batch_findings(batches: DataFrame, items: DataFrame, keys: list[str], max_items: int, max_chars: int) -> DataFrame:
    """(*keys, code) of bundles whose stated accounting is wrong, that break a budget, or that hold an item twice."""
    real = items.groupBy(*keys).agg(F.count("*").alias("_n"), F.sum("chars").alias("_c"), F.countDistinct("source_id").alias("_d"))
    rows = batches.join(real, keys, "full_outer")
    checks = {
        "ITEM_COUNT_WRONG": ~F.col("items").eqNullSafe(F.col("_n")), "CHARS_WRONG": ~F.col("chars").eqNullSafe(F.col("_c")), "TOO_MANY_ITEMS": F.col("_n") > max_items, "TOO_MANY_CHARS": (F.col("_n") > 1) & (F.col("_c") > max_chars), "ITEM_TWICE": F.col("_d") < F.col("_n"),
    }
    return rows.select(*keys, F.explode(F.filter(F.array(*(F.when(bad, code) for code, bad in checks.items())), lambda c: c.isNotNull())).alias("code"))


def equivalent(legacy: DataFrame, items: DataFrame, by: list[str]) -> DataFrame:
    """(*by, equivalent): whether all of a group's old entries meet an item of the same place and digest."""
    have = items.select(*by, "location", "digest", F.lit(1).alias("_have")).distinct()
    return legacy.join(have, [*by, "location", "digest"], "left").groupBy(*by).agg(F.every(F.col("_have").isNotNull()).alias("equivalent"))


def probe_agreement(documents: DataFrame, key: str) -> DataFrame:
    """(key, code) of documents whose stated family isn't that of the format their probe found, or that lack a fact."""
    from docweft.sources.packages import FAMILIES

    families = F.create_map(*(F.lit(x) for form, (family, _) in FAMILIES.items() for x in (form, family)))
    family = F.coalesce(F.try_element_at(families, F.col("detected_format")), F.lit("fixed_layout"))
    code = F.when(F.col("family").isNull(), "FAMILY_MISSING").when(F.col("family") != family, "FAMILY_MISMATCH").when(F.col("page_count").isNull(), "PAGES_UNKNOWN")
    return documents.select(key, code.alias("code")).where("code IS NOT NULL")
