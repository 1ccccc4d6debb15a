"""The engine's own queries, each with the SQL that another engine checks it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.functions import grids, patterns, text
from docweft.operators import bundles, coverage, groups, items, pages, redaction, signals, templates, validation
from docweft.plans import derived
from docweft.plans.derived import with_sql
from docweft.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# The other engine's regular expressions know no look-around: bounds are matched as characters, and what may stand
# between two matches is doubled first, so that each match has its own.
SP = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _norm(value: str) -> str:
    return f"trim(regexp_replace(coalesce({value}, ''), '{SP}+', ' ', 'g'))"


def _trail(value: str) -> str:
    return f"regexp_replace({value}, '[.,;:!?，。；：！？、)]+$', '')"



def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


def _items(spark: SparkSession, folder: str) -> DataFrame:
    return derived.items(spark, folder)


# ---- items -------------------------------------------------------------------------------------------------------


@query(f"""
    WITH lines AS (SELECT doc_id, unnest(string_split(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS line, generate_subscripts(string_split(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), 1) AS n FROM documents)
    SELECT doc_id, count(*) AS lines, max(n) AS last_line, sum(length(line)) AS chars FROM lines WHERE regexp_matches(line, '[^\\s\\x{{a0}}\\x{{3000}}]') GROUP BY doc_id
""")
def item_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A10: lines of texts as items; blank lines are dropped but counted."""
    lines = items.line_items(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text")
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.max("line").alias("last_line"), F.sum(F.length("text")).alias("chars"))


@query(f"""
    SELECT row_id, upper(coalesce(kind, '')) || '-' || substring(upper(sha256(coalesce(kind, '') || '|' || coalesce(location, '') || '|' || {_norm('text')} || '|' || coalesce(sha256, ''))), 1, 12) AS stable_id FROM inventory_item
""")
def item_stable_id(spark: SparkSession, folder: str) -> DataFrame:
    """Ids from kind, location, normalised text and digest."""
    rows = table(spark, folder, "inventory_item", "row_id", "kind", "location", "text", "sha256")
    return rows.select("row_id", text.stable_id(F.col("kind"), F.col("location"), text.normalize_text(F.col("text")), F.col("sha256")).alias("stable_id"))


@query(with_sql("items") + "SELECT document, source_id, row_id FROM items")
def item_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The first delivery of each item."""
    return items.first_deliveries(table(spark, folder, "inventory_item", "document", "source_id", "ordinal", "ingested_at", "row_id")).select("document", "source_id", "row_id")


@query(r"""
    SELECT row_id, CASE WHEN kind = 'table' THEN 'table' WHEN kind IN ('image', 'media') THEN 'asset' WHEN kind = 'relationship' THEN 'relationship' WHEN kind = 'shape_description' THEN 'description' WHEN kind = 'text' THEN 'text' ELSE 'generic' END AS payload_type,
        CASE WHEN coalesce(trim(location), '') = '' THEN 'INVENTORY_LOCATION_MISSING' WHEN kind = 'table' AND rows IS NULL THEN 'INVENTORY_TABLE_INVALID' WHEN kind IN ('image', 'media') AND NOT coalesce(regexp_full_match(sha256, '[0-9A-Fa-f]{64}'), false) THEN 'INVENTORY_ASSET_SHA_INVALID' END AS error,
        CASE WHEN kind IN ('image', 'media') THEN upper(visual_sha256) END AS visual_sha256, CASE WHEN kind = 'table' THEN len(rows) END AS table_rows
    FROM inventory_item
""")
def items_typed_payload(spark: SparkSession, folder: str) -> DataFrame:
    """Tagged payloads, with errors as codes."""
    rows = items.typed_payload(table(spark, folder, "inventory_item"))
    return rows.select("row_id", F.col("payload.type").alias("payload_type"), "error", "payload.visual_sha256", F.when(F.col("payload.type") == "table", F.when(F.col("error").isNull() | (F.col("error") != "INVENTORY_TABLE_INVALID"), F.size("payload.rows").cast("bigint"))).alias("table_rows"))


_REGION = " ".join(
    f"WHEN {h} LIKE '%notesmasters/%' OR {h} LIKE 'notes\\_master:%' ESCAPE '\\' THEN 'notes_master' WHEN {h} LIKE '%notesslides/%' OR {h} LIKE 'notes:%' THEN 'notes' WHEN {h} LIKE '%slidemasters/%' OR {h} LIKE 'slide\\_master:%' ESCAPE '\\' THEN 'slide_master' WHEN {h} LIKE '%slidelayouts/%' OR {h} LIKE 'slide\\_layout:%' ESCAPE '\\' THEN 'slide_layout' WHEN {h} LIKE 'slide:%' OR regexp_matches({h}, '(?:^|/)slides/slide[0-9]+\\.xml(?:/|$)') THEN 'slide'"
    for h in ("lower(replace(coalesce(location, ''), '\\', '/'))", "lower(replace(coalesce(part, ''), '\\', '/'))", "lower(replace(coalesce(source_part, ''), '\\', '/'))")
)


@query(f"SELECT coalesce(region, '-') AS region, count(*) AS n FROM (SELECT CASE {_REGION} ELSE nullif(trim(region), '') END AS region FROM inventory_item) GROUP BY 1")
def region_classify(spark: SparkSession, folder: str) -> DataFrame:
    """Regions from location and part hints."""
    rows = table(spark, folder, "inventory_item", "location", "part", "source_part", "region")
    found = items.region(*(F.col(c) for c in ("location", "part", "source_part", "region")))
    return rows.groupBy(F.coalesce(found, F.lit("-")).alias("region")).agg(F.count("*").alias("n"))


@query(r"""
    SELECT row_id, coalesce(page, try_cast(regexp_extract(coalesce(location, ''), '(?:^|/)page:([0-9]{1,9})(?:/|$)', 1) AS INTEGER)) AS page, coalesce(slide, try_cast(regexp_extract(coalesce(location, ''), '(?:^|/)slide:([0-9]{1,9})(?:/|$)', 1) AS INTEGER)) AS slide FROM inventory_item
""")
def item_positions(spark: SparkSession, folder: str) -> DataFrame:
    """C4: page and slide of each item."""
    rows = table(spark, folder, "inventory_item", "row_id", "location", "page", "slide")
    return rows.select("row_id", items.position(F.col("location"), "page", F.col("page")).alias("page"), items.position(F.col("location"), "slide", F.col("slide")).alias("slide"))


@query(r"""
    WITH fields AS (
        SELECT item_id, 'payload.text' AS field, payload.text AS text FROM typed_item WHERE payload.type IN ('text', 'description')
        UNION ALL SELECT item_id, 'payload.name', payload.name FROM typed_item WHERE payload.type IN ('asset', 'description')
        UNION ALL SELECT item_id, 'payload.title', payload.title FROM typed_item WHERE payload.type = 'description'
        UNION ALL SELECT item_id, 'payload.description', payload.description FROM typed_item WHERE payload.type = 'description'
        UNION ALL SELECT item_id, 'payload.target', payload.target FROM typed_item WHERE payload.type = 'relationship'
        UNION ALL SELECT item_id, 'payload.value', payload.value_json FROM typed_item WHERE payload.type = 'generic'
        UNION ALL SELECT item_id, 'payload.rows[' || (r - 1) || '][' || (c - 1) || ']', payload.rows[r][c] FROM (SELECT item_id, payload, r, unnest(range(1, len(payload.rows[r]) + 1)) AS c FROM (SELECT item_id, payload, unnest(range(1, len(payload.rows) + 1)) AS r FROM typed_item WHERE payload.type = 'table'))
        UNION ALL SELECT item_id, 'location', location FROM typed_item
        UNION ALL SELECT item_id, 'attributes.' || k, attributes[k] FROM (SELECT item_id, attributes, unnest(map_keys(attributes)) AS k FROM typed_item)
    )
    SELECT item_id, field, length(text) AS chars FROM fields WHERE coalesce(text, '') <> ''
""")
def item_text_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Every text of an item with its path."""
    rows = items.text_fields(table(spark, folder, "typed_item", "item_id", "payload", "location", "attributes"), ["item_id"])
    return rows.select("item_id", "field", F.length("text").alias("chars"))


_CLEAN = f"trim(regexp_replace(coalesce(text, ''), '{SP}+', ' ', 'g'))"


@query(f"""
    SELECT row_id, CASE WHEN substring({_CLEAN}, 1, 500) = '' THEN kind || ' source item' ELSE substring({_CLEAN}, 1, 500) END AS summary, CASE WHEN coalesce(text, '') <> '' AND length(text) <= 4000 THEN length(text) END AS inline_chars FROM inventory_item
""")
def compact_item_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Summaries and inline texts."""
    rows = items.compact(table(spark, folder, "inventory_item", "row_id", "kind", "text", "rows"))
    return rows.select("row_id", "summary", F.length("inline_text").alias("inline_chars"))


_ROWS_TEXT = "array_to_string(list_transform(rows, lambda r: array_to_string(list_transform(coalesce(r, []), lambda c: coalesce(c, '')), chr(9))), chr(10))"


@query(f"SELECT row_id, sha256(CASE WHEN rows IS NOT NULL THEN coalesce({_ROWS_TEXT}, '') ELSE coalesce(text, '') END) AS digest FROM inventory_item")
def item_source_text(spark: SparkSession, folder: str) -> DataFrame:
    """An item's text, tables joined."""
    rows = table(spark, folder, "inventory_item", "row_id", "text", "rows")
    return rows.select("row_id", F.sha2(items.source_text(F.col("text"), F.col("rows")), 256).alias("digest"))


@query(r"""
    SELECT label, count(*) AS n FROM (SELECT CASE WHEN regexp_extract(l, 'paragraph:([0-9]+)', 1) <> '' THEN 'paragraph ' || regexp_extract(l, 'paragraph:([0-9]+)', 1) WHEN regexp_extract(l, 'slide:([0-9]+)', 1) <> '' THEN 'slide ' || regexp_extract(l, 'slide:([0-9]+)', 1)
        WHEN regexp_extract(l, 'page:([0-9]+)', 1) <> '' THEN 'page ' || regexp_extract(l, 'page:([0-9]+)', 1) ELSE 'source' END AS label FROM (SELECT coalesce(location, '') AS l FROM inventory_item)) GROUP BY label
""")
def location_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Locations for a reader."""
    return table(spark, folder, "inventory_item", "location").groupBy(items.location_label(F.col("location")).alias("label")).agg(F.count("*").alias("n"))


@query(r"""
    WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM documents),
    b AS (SELECT doc_id, regexp_replace(t, '^[ \n]+|[ \n]+$', '', 'g') AS t FROM a)
    SELECT doc_id, sha256(CASE WHEN length(t) <= 1200 THEN t ELSE regexp_replace(substring(t, 1, 1198), '[ \n]+$', '') || '……' END) AS digest FROM b
""")
def preview_text_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Readable previews."""
    return table(spark, folder, "documents", "doc_id", "text").select("doc_id", F.sha2(text.preview_text(F.col("text")), 256).alias("digest"))


@query(with_sql("items") + "SELECT row_id, nullif(concat_ws(' | ', nullif(trim(name), ''), nullif(trim(title), ''), nullif(trim(description), '')), '') AS shown FROM items WHERE kind = 'shape_description'")
def description_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Names, titles and descriptions of shapes."""
    rows = _items(spark, folder).where("kind = 'shape_description'")
    return rows.select("row_id", items.description_text(F.col("name"), F.col("title"), F.col("description")).alias("shown"))


@query(r"""
    SELECT document, CASE WHEN n = '' THEN '_' ELSE n END AS stem FROM (SELECT document, regexp_replace(substring(regexp_replace(coalesce(file_name, ''), '[<>:"/\\|?*\x00-\x1f]+', '_', 'g'), 1, 120), '[. ]+$', '') AS n FROM source_document)
""")
def safe_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names that any file system takes."""
    return table(spark, folder, "source_document", "document", "file_name").select("document", text.safe_filename(F.col("file_name")).alias("stem"))


@query(r"""
    SELECT document, detected_format, lower(regexp_extract(file_name, '(\.[^.]+)$', 1)) AS ending, lower(regexp_extract(file_name, '(\.[^.]+)$', 1)) <> '.' || detected_format AS mismatch FROM source_document WHERE detected_format IS NOT NULL AND file_name IS NOT NULL
""")
def extension_mismatch(spark: SparkSession, folder: str) -> DataFrame:
    """Endings that contradict the detected format."""
    ending = F.lower(F.regexp_extract("file_name", r"(\.[^.]+)$", 1))
    rows = table(spark, folder, "source_document", "document", "file_name", "detected_format").where("detected_format IS NOT NULL AND file_name IS NOT NULL")
    return rows.select("document", "detected_format", ending.alias("ending"), (ending != F.concat(F.lit("."), "detected_format")).alias("mismatch"))


# ---- tables ------------------------------------------------------------------------------------------------------


@query("SELECT row_id, len(rows) AS table_rows, coalesce(list_max(list_transform(rows, lambda r: len(coalesce(r, [])))), 0) AS width, length(coalesce(" + _ROWS_TEXT + ", '')) AS chars FROM inventory_item WHERE rows IS NOT NULL")
def table_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, width and joined length of ragged tables."""
    r = F.col("rows")
    return table(spark, folder, "inventory_item", "row_id", "rows").where("rows IS NOT NULL").select("row_id", F.size(r).alias("table_rows"), grids.width(r).alias("width"), F.length(grids.joined_text(r)).alias("chars"))


def _token(cell: str) -> str:
    return rf"lower(regexp_replace({cell}, '[\s\.．、,，:：;；\-_/\\()（）\[\]【】]+', '', 'g'))"


def _serial(cell: str) -> str:
    return rf"regexp_full_match({_token(cell)}, '\d+|[一二三四五六七八九十百千零〇]+|[①②③④⑤⑥⑦⑧⑨⑩]+|[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]+')"


@query(f"""
    WITH t AS (SELECT row_id, list_transform(rows, lambda r: list_transform(coalesce(r, []), lambda c: coalesce(c, ''))) AS rows FROM inventory_item WHERE rows IS NOT NULL),
    f AS (SELECT row_id, rows, list_transform(rows, lambda r: trim(coalesce(r[1], ''))) AS first FROM t),
    g AS (SELECT row_id, rows, list_filter(first, lambda c: c <> '') AS filled, list_filter(first[2:], lambda c: c <> '') AS behind FROM f)
    SELECT row_id, coalesce(len(rows) >= 2 AND len(filled) > 0 AND CASE WHEN {_token("coalesce(filled[1], '')")} IN ('序号', '序列号', '编号', 'no') THEN len(behind) > 0 AND len(list_filter(behind, lambda c: NOT {_serial('c')})) = 0
        ELSE len(list_filter(rows, lambda r: len(list_filter(r[2:], lambda c: trim(c) <> '')) > 0)) > 0 AND len(list_filter(filled, lambda c: NOT {_serial('c')})) = 0 END, false) AS serial FROM g
""")
def serial_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Tables whose first column only numbers the rows."""
    return table(spark, folder, "inventory_item", "row_id", "rows").where("rows IS NOT NULL").select("row_id", grids.has_serial_column(F.col("rows")).alias("serial"))


# ---- signals and facts -------------------------------------------------------------------------------------------

# all sources of texts that signals are looked for in
_TEXTS = "(SELECT row_id, text FROM inventory_item WHERE text IS NOT NULL UNION ALL SELECT row_id, target FROM inventory_item WHERE target IS NOT NULL)"


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "inventory_item", "row_id", "text", "target")
    return rows.where("text IS NOT NULL").select("row_id", "text").unionByName(rows.where("target IS NOT NULL").select("row_id", F.col("target").alias("text")))


def _signals(spark: SparkSession, folder: str, name: str, pattern: str, group: int = 0) -> DataFrame:
    return _texts(spark, folder).select("row_id", F.explode(patterns.signal_values(F.col("text"), pattern, group)).alias("value"))


def _signal_sql(pattern: str, group: int = 1, doubled: str = r"[\s,;，；、。：:()（）/\[\]]") -> str:
    source = f"regexp_replace(text, '({doubled})', '\\1\\1', 'g')" if doubled else "text"
    return f"SELECT row_id, value FROM (SELECT row_id, {_trail('v')} AS value FROM (SELECT row_id, unnest(regexp_extract_all({source}, '{pattern}', {group})) AS v FROM {_TEXTS})) WHERE value <> ''"


_LABEL = "[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
_EMAIL = rf"(?:^|[^\p{{L}}\p{{N}}_.+-])([A-Za-z0-9.!#$%&''*+/=?^_`{{|}}~-]+@{_LABEL}(?:\.{_LABEL})+)(?:$|[^\p{{L}}\p{{N}}_-])"
# addresses hold some of the doubled signs, so only white space and Han punctuation is doubled for them
_GAP = r"[\s，；、。：（）]"


@query(_signal_sql(_EMAIL, doubled=_GAP))
def email_signals(spark: SparkSession, folder: str) -> DataFrame:
    """E-mail addresses."""
    return _signals(spark, folder, "email", patterns.EMAIL)


@query(_signal_sql(r"(?i)(?:^|[^\p{L}\p{N}_])((?:https?://|www\.)[^\s<>\[\]{}\"''，。；、]+)", doubled=_GAP))
def url_signals(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses of pages."""
    return _signals(spark, folder, "url", patterns.URL)


@query(_signal_sql(r"(?i)(?:^|[^@\p{L}\p{N}_-])((?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+(?:com|cn|net|org|gov|edu|io|co|biz|info|tech|ai|xyz|top|shop|site))(?:$|[^\p{L}\p{N}_-])", doubled=r"[\s，；、。：（）/]"))
def domain_signals(spark: SparkSession, folder: str) -> DataFrame:
    """Bare domains."""
    return _signals(spark, folder, "domain", patterns.DOMAIN)


@query(_signal_sql(r"(?:^|[^\d])((?:\+?86[-\s]?)?1[3-9]\d{9})(?:$|[^\d])", doubled=r"[^\d+\s-]"))
def mobile_signals(spark: SparkSession, folder: str) -> DataFrame:
    """Mobile numbers."""
    return _signals(spark, folder, "phone", patterns.MOBILE)


@query(_signal_sql(r"(?i)(?:电话|手机|热线|传真|tel(?:ephone)?|phone|fax)\s*[:：]?\s*((?:\+?86[-\s]?)?(?:0\d{2,3}[-\s]?)?\d{7,11}(?:[-转]\d{1,6})?)", doubled=""))
def labelled_phone_signals(spark: SparkSession, folder: str) -> DataFrame:
    """E5: labelled telephone and fax numbers."""
    return _signals(spark, folder, "phone", patterns.LABELLED_PHONE, 1)


@query(_signal_sql(r"([\x{4e00}-\x{9fff}A-Za-z0-9（）()·&]{2,40}?(?:股份有限公司|有限责任公司|有限公司|集团有限公司|集团|研究院|研究所))", doubled=""))
def organisation_signals(spark: SparkSession, folder: str) -> DataFrame:
    """Names that end like an organisation's."""
    return _signals(spark, folder, "organization_name", patterns.ORGANISATION)


@query()
def signal_positions(spark: SparkSession, folder: str) -> DataFrame:
    """Signals with offsets, excerpt and id."""
    fields = items.text_fields(table(spark, folder, "typed_item", "item_id", "payload", "location", "attributes"), ["item_id"])
    return signals.signal_offsets(fields, ["item_id"])

def _fact_sql(kind: str, pattern: str, where: str = "true", gap: str = r"[^\p{L}\p{N}_.]") -> str:
    return f"SELECT row_id, '{kind}' AS fact_kind, v AS token FROM (SELECT row_id, unnest(regexp_extract_all(regexp_replace(text, '({gap})', '\\1\\1', 'g'), '{pattern}', 1)) AS v FROM inventory_item WHERE text IS NOT NULL) WHERE {where}"


_KEY = "regexp_replace(upper(" + _norm("token") + f"), '{SP}+', '', 'g')"


@query(
    f"SELECT row_id, token, translate({_KEY}, 'ILOQSB', '110058') AS fact_key FROM ("
    + _fact_sql("model", r"(?:^|[^A-Za-z0-9])([A-Za-z][A-Za-z0-9]*(?:-[A-Za-z0-9]+)*)(?:$|[^A-Za-z0-9])", r"regexp_matches(v, '\d') AND NOT regexp_matches(upper(v), '^(ISO|IEC)')", gap=r"[^A-Za-z0-9-]")
    + ")"
)
def model_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Model numbers and their keys."""
    rows = signals.facts(table(spark, folder, "inventory_item", "row_id", "text"), ["row_id"], kinds=("model",))
    return rows.select("row_id", "token", "fact_key")


@query()
def number_unit_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Measurements and their keys (a range's look-behind has no counterpart in the other engine)."""
    rows = signals.facts(table(spark, folder, "inventory_item", "row_id", "text"), ["row_id"], kinds=("number_unit",))
    return rows.groupBy("fact_key").agg(F.count("*").alias("n"), F.countDistinct("row_id").alias("items"))


# certificates that the tables never name
_CERTIFIED = "(VALUES (1, '产品符合 ISO 9001 与 IEC-61010 标准'), (2, 'CE, FDA 注册证与检测报告'), (3, 'ACE 认证、CNAS'), (4, NULL), (5, ''))"


@query(rf"""
    WITH t AS (SELECT * FROM {_CERTIFIED} t(id, text)),
    a AS (SELECT id, replace(replace(unnest(regexp_extract_all(regexp_replace(text, '([^A-Za-z0-9])', '\1\1', 'g'), '(?i)(?:^|[^A-Za-z0-9])((?:ISO|IEC)[\s/-]*[0-9]{{{{3,6}}}}|CE|FDA|CCC|CNAS|CMA)(?:$|[^A-Za-z0-9])', 1)), '  ', ' '), '--', '-') AS token FROM t),
    b AS (SELECT id, unnest(regexp_extract_all(text, '认证|资质|证书|注册证|备案|检测机构|检测报告|合格证|许可证|专利|符合')) AS token FROM t)
    SELECT id, token, upper(token) AS folded FROM a UNION ALL SELECT id, token, upper(token) FROM b
""".replace("{{", "{").replace("}}", "}"))
def certification_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Certificates and their words, on texts given here."""
    rows = spark.createDataFrame([(1, "产品符合 ISO 9001 与 IEC-61010 标准"), (2, "CE, FDA 注册证与检测报告"), (3, "ACE 认证、CNAS"), (4, None), (5, "")], "id int, text string")
    found = signals.facts(rows, ["id"], kinds=("certification",))
    return found.select("id", "token", F.upper("token").alias("folded"))


@query(r"""
    SELECT row_id, CASE WHEN lower(target) LIKE 'mailto:%' THEN regexp_extract(lower(target), '^mailto:[^?]*@([^@?]+)', 1) WHEN target LIKE '%://%' OR target LIKE '//%' THEN regexp_extract(lower(target), '^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:@]*)', 1) ELSE regexp_extract(lower(target), '^(?:[^/?#@]*@)?([^/?#:@]+)', 1) END AS host,
        lower(coalesce(target_mode, '')) = 'external' OR regexp_matches(lower(coalesce(target, '')), '^(?:[a-z][a-z0-9+.-]*://[^/]|mailto:|file:)') AS is_external
    FROM (SELECT row_id, trim(coalesce(target, '')) AS target, target_mode FROM inventory_item WHERE kind = 'relationship')
""")
def link_hosts(spark: SparkSession, folder: str) -> DataFrame:
    """Hosts of links and whether they leave the package."""
    rows = table(spark, folder, "inventory_item", "row_id", "kind", "target", "target_mode").where("kind = 'relationship'")
    return rows.select("row_id", patterns.target_host(F.col("target")).alias("host"), patterns.is_external(F.trim(F.coalesce("target", F.lit(""))), F.col("target_mode")).alias("is_external"))


_DOMAINS = "SELECT DISTINCT regexp_extract(lower(target), '^https?://([^/]+)', 1) AS domain FROM inventory_item WHERE kind = 'relationship' AND right(source_id, 1) IN ('0', '1', '2', '3')"


@query(f"""
    WITH domains AS ({_DOMAINS}), hosts AS (SELECT row_id, regexp_extract(lower(target), '^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:@]*)', 1) AS host FROM inventory_item WHERE kind = 'relationship' AND target LIKE '%://%')
    SELECT row_id, host, domain FROM hosts JOIN domains ON host = domain OR host LIKE '%.' || domain WHERE domain <> '' AND regexp_full_match(domain, '(?:[a-z0-9-]+\\.)+[a-z]{{2,}}')
""")
def identity_domain_match(spark: SparkSession, folder: str) -> DataFrame:
    """Links to a domain of the identity, found by their suffixes."""
    rows = table(spark, folder, "inventory_item", "row_id", "source_id", "kind", "target").where("kind = 'relationship'")
    terms = rows.where(F.right("source_id", F.lit(1)).isin("0", "1", "2", "3")).select(F.regexp_extract(F.lower("target"), "^https?://([^/]+)", 1).alias("term"))
    return signals.identity_removals(rows.where(F.col("target").contains("://")), terms, ["row_id"])


_TERMS = "(VALUES ('Tulurbrask'), ('gasket'), ('FIRMWARE'), ('控制板'), ('aa')) t(term)"


def _terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("Tulurbrask",), ("gasket",), ("FIRMWARE",), ("控制板",), ("aa",)], "term string")


@query(f"SELECT row_id, term, CAST((length(lower(text)) - length(replace(lower(text), lower(term), ''))) / length(term) AS INTEGER) AS hits FROM inventory_item, {_TERMS} WHERE contains(lower(text), lower(term))")
def term_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences of configured terms."""
    return signals.term_hits(table(spark, folder, "inventory_item", "row_id", "text"), _terms(spark), ["row_id"])


@query(f"""
    WITH hits AS (SELECT location, term, count(*) AS n FROM inventory_item, {_TERMS} WHERE contains(lower(text), lower(term)) GROUP BY ALL),
    base AS (SELECT DISTINCT location, lower(term) AS t FROM inventory_item, {_TERMS} WHERE contains(lower(text), lower(term)) AND right(source_id, 1) IN ('0', '1', '2', '3', '4', '5', '6', '7'))
    SELECT location, term, n FROM hits WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.location = hits.location AND base.t = lower(hits.term))
""")
def term_hits_baseline_subtract(spark: SparkSession, folder: str) -> DataFrame:
    """hits that a baseline of (part, term) doesn't explain."""
    rows = table(spark, folder, "inventory_item", "location", "source_id", "text")
    hits = signals.term_hits(rows, _terms(spark), ["location", "source_id"])
    base = hits.where(F.right("source_id", F.lit(1)).isin(*"01234567")).select("location", "term")
    return coverage.subtract_baseline(hits.groupBy("location", "term").agg(F.count("*").alias("n")), base, "location", "term")


@query("SELECT any_value(lower(trim(term))) AS folded, count(DISTINCT document) AS documents FROM (SELECT document, unnest(manufacturer_terms) AS term FROM identity_review) WHERE trim(term) <> '' GROUP BY lower(trim(term))")
def identity_terms_distinct(spark: SparkSession, folder: str) -> DataFrame:
    """Terms that differ only in case count once per document."""
    rows = table(spark, folder, "identity_review", "document", "review_id", "manufacturer_terms").select("document", "review_id", F.explode("manufacturer_terms").alias("term"))
    one = signals.distinct_ignoring_case(rows, ["document"], "term", ["review_id", "term"])
    return one.groupBy(F.lower(F.trim("term")).alias("folded")).agg(F.countDistinct("document").alias("documents"))


@query(with_sql("items") + r"""
    , found AS (
        SELECT document, source_id, 'OBVIOUS_TABLE_ITEM' AS c FROM items WHERE kind = 'table' UNION ALL SELECT document, source_id, 'OBVIOUS_TEXT_ITEM' FROM items WHERE kind IN ('text', 'shape_description')
        UNION ALL SELECT document, source_id, 'OCR_TEXT_ITEM' FROM items WHERE kind IN ('text', 'shape_description') AND extraction = 'ocr' UNION ALL SELECT document, source_id, 'IMAGE_ITEM' FROM items WHERE kind IN ('image', 'media')
        UNION ALL SELECT document, source_id, 'EXTERNAL_RELATIONSHIP_ITEM' FROM items WHERE kind = 'relationship'
        UNION ALL SELECT document, source_id, 'REPEATED_ASSET_CANDIDATE' FROM (SELECT document, source_id, count(*) OVER (PARTITION BY document, upper(coalesce(nullif(visual_sha256, ''), nullif(sha256, '')))) AS n FROM items WHERE kind IN ('image', 'media') AND coalesce(nullif(visual_sha256, ''), nullif(sha256, '')) IS NOT NULL) WHERE n >= 2
    )
    SELECT document, source_id, string_agg(DISTINCT c, ',' ORDER BY c) AS reason_codes FROM found GROUP BY ALL
""")
def reason_code_sets(spark: SparkSession, folder: str) -> DataFrame:
    """What the items' kinds and repetitions give as reasons."""
    return signals.reason_codes(_items(spark, folder), ["document", "source_id"], "document")


# ---- groups ------------------------------------------------------------------------------------------------------


@query("SELECT upper(coalesce(nullif(visual_sha256, ''), nullif(sha256, ''))) AS digest, count(*) AS occurrences FROM inventory_item WHERE kind IN ('image', 'media') GROUP BY ALL HAVING count(*) >= 2 AND digest IS NOT NULL")
def repeated_assets(spark: SparkSession, folder: str) -> DataFrame:
    """G1: assets that repeat over all deliveries."""
    return signals.repeated_assets(table(spark, folder, "inventory_item", "kind", "sha256", "visual_sha256"), [])


@query(with_sql("items") + "SELECT document, count(*) AS items, count(*) FILTER (kind = 'text') AS texts, count(*) FILTER (kind = 'table') AS tables, count(*) FILTER (kind IN ('image', 'media')) AS assets, count(*) FILTER (right(source_id, 1) = 'D') AS open FROM items GROUP BY document")
def doc_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of a document's items."""
    k = F.col("kind")
    return _items(spark, folder).groupBy("document").agg(F.count("*").alias("items"), F.count_if(k == "text").alias("texts"), F.count_if(k == "table").alias("tables"), F.count_if(k.isin("image", "media")).alias("assets"), F.count_if(F.right("source_id", F.lit(1)) == "D").alias("open"))


@query(with_sql("items") + """
    , n AS (SELECT document, page, count(*) FILTER (extraction = 'pdf_text') AS native, count(*) FILTER (extraction = 'ocr') AS ocr FROM items WHERE page IS NOT NULL GROUP BY ALL)
    SELECT d.document, d.page, coalesce(native, 0) AS native, coalesce(ocr, 0) AS ocr FROM (SELECT document, unnest(range(1, page_count + 1)) AS page FROM source_document WHERE page_count >= 1) d LEFT JOIN n USING (document, page)
""")
def page_densify(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of every declared page, empty ones included."""
    rows = _items(spark, folder).where("page IS NOT NULL").groupBy("document", "page").agg(F.count_if(F.col("extraction") == "pdf_text").alias("native"), F.count_if(F.col("extraction") == "ocr").alias("ocr"))
    return groups.densified(rows, table(spark, folder, "source_document", "document", "page_count"), "document", "page", "page_count", ["native", "ocr"])


@query(with_sql("items") + "SELECT document, slide, array_to_string(list(source_id ORDER BY ordinal, source_id) FILTER (kind = 'text'), ',') AS texts, array_to_string(list(source_id ORDER BY ordinal, source_id) FILTER (kind = 'table'), ',') AS tables FROM items WHERE slide IS NOT NULL GROUP BY ALL")
def slide_id_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of a slide's texts and tables in order."""
    lists = groups.id_lists(_items(spark, folder).where("slide IS NOT NULL"), ["document", "slide"], {"texts": "kind = 'text'", "tables": "kind = 'table'"})
    joined = lambda c: F.when(F.size(c) > 0, F.array_join(c, ","))
    return lists.select("document", "slide", joined("texts").alias("texts"), joined("tables").alias("tables"))


@query(with_sql("items") + """
    , p AS (SELECT document, page, count(*) AS n FROM items WHERE page IS NOT NULL AND kind = 'text' AND location LIKE '%/ocr' GROUP BY ALL), d AS (SELECT document, unnest(range(1, page_count + 1))::INTEGER AS page FROM source_document WHERE page_count >= 1)
    SELECT document, page, 'MISSING' AS code FROM d WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.document = d.document AND p.page = d.page)
    UNION ALL SELECT p.document, p.page, 'EXTRA' FROM p JOIN source_document s USING (document) WHERE p.page < 1 OR p.page > s.page_count UNION ALL SELECT document, page, 'DUPLICATE' FROM p WHERE n > 1
""")
def page_sequence_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Missing, extra and doubled pages."""
    rows = _items(spark, folder).where("kind = 'text' AND location LIKE '%/ocr'").select("document", "page")
    return groups.sequence_findings(rows, table(spark, folder, "source_document", "document", "page_count"), "document", "page", "page_count")


@query(with_sql("items") + "SELECT document, page AS after, before FROM (SELECT document, page, lead(page) OVER (PARTITION BY document ORDER BY page) AS before FROM (SELECT DISTINCT document, page FROM items WHERE page IS NOT NULL AND kind = 'table')) WHERE before > page + 1")
def page_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Gaps between pages with tables."""
    return groups.gaps(_items(spark, folder).where("kind = 'table'"), "document", "page")


_RANK = "CASE status WHEN 'BLOCKED' THEN 0 WHEN 'FAIL' THEN 1 WHEN 'HUMAN_REVIEW' THEN 2 WHEN 'PASS' THEN 3 ELSE 1 END"


@query(with_sql("stages") + f"SELECT c_custkey AS run, CASE coalesce(r, 1) WHEN 0 THEN 'BLOCKED' WHEN 1 THEN 'FAIL' WHEN 2 THEN 'HUMAN_REVIEW' ELSE 'PASS' END AS status FROM customer LEFT JOIN (SELECT run, min({_RANK}) AS r FROM stages GROUP BY run) ON run = c_custkey")
def status_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """The worst status of each run; no stage is FAIL."""
    return groups.status_rollup(derived.stages(spark, folder), ["run"], universe=table(spark, folder, "customer", "c_custkey").withColumnRenamed("c_custkey", "run"))


@query(with_sql("reviews") + "SELECT document, CASE WHEN bool_and(action = 'APPROVE') THEN 'APPROVED' WHEN bool_or(action = 'REJECT') THEN 'REJECTED' WHEN bool_or(action = 'REQUEST_REVISION') THEN 'REVISION_REQUESTED' ELSE 'FACT_PENDING' END AS overall FROM reviews GROUP BY document")
def review_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """The overall action of a document's reviews."""
    return groups.review_rollup(derived.reviews(spark, folder), ["document"])


@query(with_sql("stages") + "SELECT stage, count(*) AS stages, round(sum(duration_ms), 3) AS duration_ms, count(*) FILTER (cache_status = 'HIT') AS hits, count(*) FILTER (cache_status IN ('HIT', 'MISS', 'CORRUPT')) AS lookups, round(count(*) FILTER (cache_status = 'HIT') / count(*) FILTER (cache_status IN ('HIT', 'MISS', 'CORRUPT')), 6) AS hit_rate FROM stages GROUP BY stage")
def telemetry_report(spark: SparkSession, folder: str) -> DataFrame:
    """Durations and cache hits by stage."""
    return groups.telemetry(derived.stages(spark, folder), ["stage"])


@query(with_sql("items") + "SELECT kind, CASE WHEN kind = 'text' THEN coalesce(extraction, '-') ELSE '*' END AS how, count(*) AS n FROM items GROUP BY ALL")
def kind_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """A histogram of kinds."""
    return _items(spark, folder).groupBy("kind", F.when(F.col("kind") == "text", F.coalesce("extraction", F.lit("-"))).otherwise("*").alias("how")).agg(F.count("*").alias("n"))


@query(with_sql("items") + "SELECT document, upper(sha256) AS sha256 FROM items WHERE kind = 'image' AND sha256 IS NOT NULL AND right(source_id, 1) IN ('0', '1', '2', '3', '4', '5', '6', '7') EXCEPT ALL SELECT document, upper(sha256) FROM items WHERE kind = 'image' AND sha256 IS NOT NULL AND right(source_id, 1) IN ('8', '9', 'A', 'B')")
def media_multiset_difference(spark: SparkSession, folder: str) -> DataFrame:
    """Pictures that one side has more often."""
    rows = _items(spark, folder).where("kind = 'image' AND sha256 IS NOT NULL").select("document", F.upper("sha256").alias("sha256"), F.right("source_id", F.lit(1)).alias("d"))
    return groups.multiset_difference(rows.where(F.col("d").isin(*"01234567")).drop("d"), rows.where(F.col("d").isin(*"89AB")).drop("d"))


@query(with_sql("items") + r"""
    , g AS (SELECT document, kind, source_id, count(*) OVER (PARTITION BY document, kind) AS total, row_number() OVER (PARTITION BY document, kind ORDER BY ordinal, source_id) AS n FROM items WHERE kind IN ('relationship', 'media', 'other'))
    SELECT document, kind, any_value(total) AS total, string_agg(source_id, '; ' ORDER BY n) FILTER (n <= CASE WHEN total > 5 THEN 3 ELSE 5 END) AS shown FROM g GROUP BY document, kind
""")
def excluded_examples(spark: SparkSession, folder: str) -> DataFrame:
    """Totals with a few examples."""
    return groups.examples(_items(spark, folder).where("kind IN ('relationship', 'media', 'other')"), ["document", "kind"], "source_id", ["ordinal", "source_id"])


@query()
def greedy_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks of at most 40 items and 16 000 characters (checked against a plain fold in the tests)."""
    rows = items.compact(_items(spark, folder).select("document", "ordinal", "source_id", "kind", "text", "rows"))
    return bundles.pack(rows, "document", ["ordinal", "source_id"], "inline_chars")


@query(with_sql("items", "headings") + "SELECT document, ordinal, title, lead(ordinal) OVER (PARTITION BY document ORDER BY ordinal) AS until FROM headings")
def heading_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """From a heading to the next."""
    return groups.ranges_to_next(derived.headings(_items(spark, folder)), "document", "ordinal")


@query(with_sql("items", "headings") + ", r AS (SELECT document, ordinal, title, lead(ordinal) OVER (PARTITION BY document ORDER BY ordinal) AS until FROM headings) SELECT i.row_id, r.title AS section FROM items i LEFT JOIN r ON i.document = r.document AND i.ordinal >= r.ordinal AND (r.until IS NULL OR i.ordinal < r.until) WHERE i.kind IN ('image', 'table')")
def items_in_sections(spark: SparkSession, folder: str) -> DataFrame:
    """the section a picture or table stands in."""
    rows = _items(spark, folder)
    return coverage.in_section(rows.where("kind IN ('image', 'table')").select("document", "ordinal", "row_id"), derived.headings(rows), "document", "ordinal", "title").select("row_id", "section")


@query(with_sql("items") + """
    , n AS (SELECT document, ordinal, source_id, row_id, kind, row_number() OVER (PARTITION BY document ORDER BY ordinal, source_id) AS a FROM items), h AS (SELECT *, a - row_number() OVER (PARTITION BY document ORDER BY ordinal, source_id) AS g FROM n WHERE kind = 'image')
    SELECT row_id, row_number() OVER (PARTITION BY document, g ORDER BY a) AS place, CAST(ceil(row_number() OVER (PARTITION BY document, g ORDER BY a) / 2) AS BIGINT) AS grid_row FROM h
""")
def image_grids(spark: SparkSession, folder: str) -> DataFrame:
    """I4: runs of pictures set in grids of two columns."""
    rows = _items(spark, folder).withColumn("_o", F.struct("ordinal", "source_id"))
    return groups.islands(rows, "document", "_o", "kind = 'image'").select("row_id", "place", F.ceil(F.col("place") / 2).alias("grid_row"))


@query(with_sql("items") + "SELECT row_id, lead(kind) OVER (PARTITION BY document ORDER BY ordinal, source_id) = 'image' AS before_image FROM items WHERE kind IN ('text', 'image')")
def followed_by_image(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that a picture follows."""
    from pyspark.sql import Window

    rows = _items(spark, folder).where("kind IN ('text', 'image')")
    return rows.select("row_id", (F.lead("kind").over(Window.partitionBy("document").orderBy("ordinal", "source_id")) == "image").alias("before_image"))


@query(with_sql("items") + "SELECT DISTINCT document, page, page = min(page) OVER (PARTITION BY document) OR page = max(page) OVER (PARTITION BY document) AS is_edge FROM items WHERE page IS NOT NULL")
def edge_pages(spark: SparkSession, folder: str) -> DataFrame:
    """First and last pages."""
    return groups.edges(_items(spark, folder).where("page IS NOT NULL").select("document", "page").distinct(), "document", "page")


# ---- decisions ---------------------------------------------------------------------------------------------------


@query(with_sql("items", "decisions") + "SELECT d.document, d.source_id, d.action, i.kind, row_number() OVER (PARTITION BY d.document ORDER BY d.target_order, d.source_id) AS execution_order FROM decisions d JOIN items i USING (document, source_id)")
def content_plan(spark: SparkSession, folder: str) -> DataFrame:
    """F1, H6: decisions with their items in execution order."""
    rows = _items(spark, folder)
    return coverage.plan(derived.decisions(rows), rows.select("document", "source_id", "kind"), ["document", "source_id"], ["document"], ["target_order", "source_id"]).select("document", "source_id", "action", "kind", "execution_order")


@query(with_sql("items", "decisions") + "SELECT document, source_id, 'SOURCE_NOT_DECIDED' AS code FROM items WHERE (document, source_id) NOT IN (SELECT (document, source_id) FROM decisions) UNION ALL SELECT DISTINCT document, source_id, 'DECISION_UNKNOWN_SOURCE' FROM decisions WHERE source_id LIKE 'GHOST-%'")
def coverage_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Sources without decision and decisions without source."""
    rows = _items(spark, folder)
    return coverage.coverage(rows, derived.decisions(rows), ["document", "source_id"])


@query(with_sql("items", "decisions", "unresolved") + "SELECT document, source_id FROM decisions INTERSECT SELECT document, source_id FROM unresolved")
def decided_unresolved_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Decided and unresolved at once."""
    rows = _items(spark, folder)
    return coverage.conflicts(derived.decisions(rows), derived.unresolved(rows), ["document", "source_id"])


@query(with_sql("items", "decisions") + ", extra AS (SELECT document, source_id FROM items WHERE right(source_id, 1) IN ('D', 'E', '0')) SELECT document, source_id, 'given' AS origin FROM decisions UNION ALL SELECT document, source_id, 'added' FROM extra WHERE (document, source_id) NOT IN (SELECT (document, source_id) FROM decisions)")
def merge_missing_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Additions where nothing is decided yet."""
    rows = _items(spark, folder)
    extra = rows.where(F.right("source_id", F.lit(1)).isin("D", "E", "0")).select("document", "source_id")
    return coverage.merge_missing(derived.decisions(rows).select("document", "source_id"), extra, ["document", "source_id"])


@query("SELECT evidence_id, CASE WHEN any_value(e2.kind) IS NOT NULL THEN any_value(e2.kind) ELSE any_value(e1.kind) END AS kind FROM (SELECT evidence_id, min(kind) AS kind FROM evidence GROUP BY 1) e1 FULL JOIN (SELECT evidence_id, max(path) AS kind FROM evidence WHERE page_or_position IS NULL GROUP BY 1) e2 USING (evidence_id) GROUP BY evidence_id")
def evidence_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence replaced by key."""
    rows = table(spark, folder, "evidence", "evidence_id", "kind", "path", "page_or_position")
    current = rows.groupBy("evidence_id").agg(F.min("kind").alias("kind"))
    changes = rows.where("page_or_position IS NULL").groupBy("evidence_id").agg(F.max("path").alias("kind"))
    return coverage.upsert(current, changes, ["evidence_id"], ["kind"])


@query("""
    WITH cited AS (SELECT DISTINCT document, CASE WHEN review_id % 3 = 0 THEN 'nobody' ELSE document END AS owner, unnest(evidence_ids) AS evidence_id FROM identity_review WHERE document IS NOT NULL), own AS (SELECT DISTINCT document, evidence_id FROM evidence)
    SELECT c.document, c.owner, c.evidence_id, CASE WHEN o.evidence_id IS NULL THEN 'EVIDENCE_UNKNOWN' ELSE 'EVIDENCE_OF_OTHER_SOURCE' END AS code FROM cited c LEFT JOIN own o ON o.document = c.document AND o.evidence_id = c.evidence_id WHERE o.evidence_id IS NULL OR c.owner <> c.document
""")
def evidence_ownership(spark: SparkSession, folder: str) -> DataFrame:
    """cited evidence that is unknown or another's."""
    cited = table(spark, folder, "identity_review", "document", "review_id", "evidence_ids").where("document IS NOT NULL").select("document", F.when(F.col("review_id") % 3 == 0, "nobody").otherwise(F.col("document")).alias("owner"), F.explode("evidence_ids").alias("evidence_id"))
    return coverage.evidence_findings(cited, table(spark, folder, "evidence", "document", "evidence_id").withColumn("owner", F.col("document")), ["document"], "owner")


@query("SELECT document, source_id, count(*) AS copies, 'DUPLICATE_SOURCE_ID' AS code FROM inventory_item GROUP BY document, source_id HAVING count(*) > 1")
def duplicate_source_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Items delivered more than once."""
    return coverage.duplicates(table(spark, folder, "inventory_item", "document", "source_id"), ["document", "source_id"], "DUPLICATE_SOURCE_ID")


@query(r"""
    WITH f AS (SELECT document, row_id, extraction, unnest(regexp_extract_all(regexp_replace(text, '([^A-Za-z0-9-])', '\1\1', 'g'), '(?:^|[^A-Za-z0-9])([A-Za-z][A-Za-z0-9]*(?:-[A-Za-z0-9]+)*)(?:$|[^A-Za-z0-9])', 1)) AS v FROM inventory_item WHERE kind = 'text'),
    k AS (SELECT document, row_id, coalesce(extraction, '-') = 'ocr' AS claim, translate(upper(v), 'ILOQSB', '110058') AS fact_key FROM f WHERE regexp_matches(v, '\d') AND NOT regexp_matches(upper(v), '^(ISO|IEC)'))
    SELECT document, fact_key, count(*) AS claims FROM k WHERE claim AND (document, fact_key) NOT IN (SELECT (document, fact_key) FROM k WHERE NOT claim AND document IS NOT NULL) GROUP BY ALL
""")
def fact_support_antijoin(spark: SparkSession, folder: str) -> DataFrame:
    """model numbers of scanned texts that no native text of the document holds."""
    rows = signals.facts(table(spark, folder, "inventory_item", "document", "row_id", "kind", "extraction", "text").where("kind = 'text'"), ["document", "row_id", "extraction"], kinds=("model",))
    return signals.unsupported_counts(rows, F.coalesce("extraction", F.lit("-")) == "ocr", ["document"])


@query(with_sql("items", "decisions") + "SELECT document, source_id, CASE WHEN confidence IS NULL OR confidence < 0 OR confidence > 1 THEN 'CONFIDENCE_INVALID' ELSE 'LOW_CONFIDENCE' END AS code, CASE WHEN confidence IS NULL OR confidence < 0 OR confidence > 1 THEN 'FAIL' ELSE 'REVIEW' END AS severity FROM decisions WHERE confidence IS NULL OR confidence < 0 OR confidence > 1 OR confidence < 0.8")
def decision_findings(spark: SparkSession, folder: str) -> DataFrame:
    """L4: findings on confidence."""
    return validation.decision_findings(derived.decisions(_items(spark, folder)), ["document", "source_id"])


@query(with_sql("items", "decisions") + """
    , f AS (SELECT document, count(*) FILTER (confidence IS NULL OR confidence < 0 OR confidence > 1) AS bad, count(*) FILTER (confidence < 0.8) AS low FROM decisions GROUP BY document)
    SELECT s.document, CASE WHEN bad > 0 THEN 'FAIL' WHEN low > 0 THEN 'HUMAN_REVIEW' ELSE 'PASS' END AS verdict FROM (SELECT DISTINCT document FROM source_document) s LEFT JOIN f USING (document)
""")
def document_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """PASS, HUMAN_REVIEW or FAIL of each document."""
    found = validation.decision_findings(derived.decisions(_items(spark, folder)), ["document"])
    return groups.verdict(found, ["document"], table(spark, folder, "source_document", "document"))


@query("WITH r AS (SELECT review_id, CASE WHEN review_id % 9 = 0 THEN 'NO_SOURCE_IDENTITY_FOUND' WHEN review_id % 9 = 1 THEN 'VERIFIED' ELSE status END AS status, len(list_filter(coalesce(manufacturer_terms, []), lambda t: trim(t) <> '')) AS n FROM identity_review) SELECT review_id, CASE WHEN status = 'NO_SOURCE_IDENTITY_FOUND' THEN 'TERMS_WITHOUT_IDENTITY' ELSE 'IDENTITY_WITHOUT_TERMS' END AS code FROM r WHERE (status = 'NO_SOURCE_IDENTITY_FOUND' AND n > 0) OR (status = 'VERIFIED' AND n = 0)")
def identity_contradictions(spark: SparkSession, folder: str) -> DataFrame:
    """Reviews that contradict their terms, the status of some of them changed."""
    rows = table(spark, folder, "identity_review", "review_id", "status", "manufacturer_terms")
    status = F.when(F.col("review_id") % 9 == 0, "NO_SOURCE_IDENTITY_FOUND").when(F.col("review_id") % 9 == 1, "VERIFIED").otherwise(F.col("status"))
    return validation.identity_contradictions(rows.withColumn("status", status), ["review_id"])


@query("""
    WITH q AS (SELECT review_id, status FROM identity_review WHERE review_id % 5 <> 0), r AS (SELECT review_id, CASE WHEN review_id % 4 = 0 THEN 'OLD' ELSE status END AS status FROM identity_review WHERE review_id % 6 <> 0)
    SELECT coalesce(q.review_id, r.review_id) AS review_id, CASE WHEN r.review_id IS NULL THEN 'DECISION_MISSING' WHEN q.review_id IS NULL THEN 'DECISION_UNKNOWN_ITEM' ELSE 'RECEIPT_STALE' END AS code FROM q FULL JOIN r ON q.review_id = r.review_id WHERE q.review_id IS NULL OR r.review_id IS NULL OR q.status IS DISTINCT FROM r.status
""")
def receipt_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Receipts that are incomplete or stale."""
    rows = table(spark, folder, "identity_review", "review_id", "status")
    receipt = rows.where("review_id % 6 <> 0").withColumn("status", F.when(F.col("review_id") % 4 == 0, "OLD").otherwise(F.col("status")))
    return validation.receipt_findings(rows.where("review_id % 5 <> 0"), receipt, ["review_id"], ["status"])


@query(with_sql("items") + """
    , m AS (SELECT sha256, count(*) AS n, min(row_id) AS one FROM items WHERE kind = 'image' AND sha256 IS NOT NULL GROUP BY sha256), v AS (SELECT visual_sha256, count(*) AS n, min(row_id) AS one FROM items WHERE kind = 'image' AND visual_sha256 IS NOT NULL GROUP BY visual_sha256)
    SELECT i.source_id, i.document, coalesce(m.one, v.one) AS resolved, CASE WHEN m.one IS NOT NULL THEN 'sha256' WHEN v.one IS NOT NULL THEN 'visual_sha256' END AS via FROM items i LEFT JOIN m ON m.sha256 = i.sha256 AND m.n = 1 LEFT JOIN v ON v.visual_sha256 = i.visual_sha256 AND v.n = 1 WHERE i.kind = 'image'
""")
def image_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """pictures found by the first digest with one match."""
    rows = _items(spark, folder).where("kind = 'image'")
    wanted = rows.select(F.struct("source_id", "document").alias("key"), "sha256", "visual_sha256")
    return coverage.unique_resolution(wanted, rows, "key", ["sha256", "visual_sha256"]).select("key.source_id", "key.document", "resolved", "via")


@query("""
    WITH old AS (SELECT DISTINCT document, location FROM inventory_item WHERE kind = 'text'), f AS (SELECT location, count(*) AS n, min(row_id) AS one FROM inventory_item WHERE kind = 'image' OR (kind = 'text' AND row_id % 3 = 0) GROUP BY location)
    SELECT o.document, o.location, CASE WHEN n IS NULL THEN 'NONE' WHEN n = 1 THEN 'ONE' ELSE 'SEVERAL' END AS match, CASE WHEN n = 1 THEN one END AS row_id FROM old o LEFT JOIN f USING (location)
""")
def migration_matches(spark: SparkSession, folder: str) -> DataFrame:
    """F16: old mappings by how many items they match."""
    rows = table(spark, folder, "inventory_item", "document", "location", "kind", "row_id")
    old = rows.where("kind = 'text'").select("document", "location").distinct()
    new = rows.where("kind = 'image' OR (kind = 'text' AND row_id % 3 = 0)")
    return coverage.matched_by_cardinality(old, new, "location")


# ---- redaction ---------------------------------------------------------------------------------------------------

_REDACT = "regexp_replace(replace(replace({0}, 'gasket', ''), '控制板', ''), '', '')"


@query(f"SELECT row_id, sha256(trim(regexp_replace(replace(replace(text, 'gasket', ''), '控制板', ''), '{SP}+', ' ', 'g'))) AS digest FROM inventory_item WHERE kind = 'text' AND text IS NOT NULL")
def redact_terms(spark: SparkSession, folder: str) -> DataFrame:
    """K1, K2: terms removed literally, then normalised."""
    rows = table(spark, folder, "inventory_item", "row_id", "kind", "text").where("kind = 'text' AND text IS NOT NULL")
    return rows.select("row_id", F.sha2(redaction.redacted(F.col("text"), F.array(F.lit("gasket"), F.lit("控制板"))), 256).alias("digest"))


@query("""
    WITH e AS (SELECT row_id, text, CASE row_id % 4 WHEN 0 THEN [] WHEN 1 THEN ['gasket'] WHEN 2 THEN ['gasket', 'unheard of'] ELSE ['控制板'] END AS redactions FROM inventory_item WHERE kind = 'text'), t AS (SELECT row_id, coalesce(text, '') AS text, unnest(redactions) AS term FROM e)
    SELECT row_id, NULL AS term, 'REDACTION_LIST_EMPTY' AS code FROM e WHERE len(redactions) = 0 UNION ALL SELECT row_id, term, 'TERM_NOT_IN_TEXT' FROM t WHERE NOT contains(text, term) UNION ALL SELECT row_id, term, 'TERM_NOT_IN_VOCABULARY' FROM t WHERE lower(term) NOT IN ('gasket', '控制板')
""")
def redact_findings(spark: SparkSession, folder: str) -> DataFrame:
    """K1: what is wrong with redaction lists."""
    rows = table(spark, folder, "inventory_item", "row_id", "kind", "text").where("kind = 'text'")
    lists = F.when(F.col("row_id") % 4 == 0, F.array().cast("array<string>")).when(F.col("row_id") % 4 == 1, F.array(F.lit("gasket"))).when(F.col("row_id") % 4 == 2, F.array(F.lit("gasket"), F.lit("unheard of"))).otherwise(F.array(F.lit("控制板")))
    return redaction.redaction_findings(rows.withColumn("redactions", lists), spark.createDataFrame([("Gasket",), ("控制板",)], "term string"), ["row_id"])


# ---- pages and templates -----------------------------------------------------------------------------------------

_METRIC = "m AS (SELECT document, page, count(*) AS content_objects, sum(length(coalesce(text, ''))) AS chars FROM items WHERE page IS NOT NULL GROUP BY ALL), p AS (SELECT document, page, CASE WHEN chars % 5 = 0 THEN 0 ELSE content_objects END AS content_objects, (chars % 7) / 2.0 AS gray_stddev, (chars % 100) / 100.0 AS content_bottom_ratio FROM m)"


def _page_metrics(spark: SparkSession, folder: str) -> DataFrame:
    rows = _items(spark, folder).where("page IS NOT NULL").groupBy("document", "page").agg(F.count("*").alias("n"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
    return rows.select("document", "page", F.when(F.col("chars") % 5 == 0, 0).otherwise(F.col("n")).alias("content_objects"), (F.col("chars") % 7 / 2.0).alias("gray_stddev"), (F.col("chars") % 100 / 100.0).alias("content_bottom_ratio"))


@query(with_sql("items") + f", {_METRIC} SELECT document, page, code FROM (SELECT document, page, CASE WHEN blank AND edge THEN 'EDGE_PAGE_BLANK' WHEN blank THEN 'BLANK_PAGE' WHEN NOT edge AND content_bottom_ratio < 0.55 THEN 'LARGE_GAP' END AS code FROM (SELECT *, content_objects = 0 AND gray_stddev <= 1.0 AS blank, page = min(page) OVER (PARTITION BY document) OR page = max(page) OVER (PARTITION BY document) AS edge FROM p)) WHERE code IS NOT NULL")
def page_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Blank and gappy pages."""
    return pages.page_findings(_page_metrics(spark, folder), ["document"])


@query(with_sql("items") + f", {_METRIC}, b AS (SELECT document, page, gray_stddev * 0.9 + 0.05 AS g FROM p WHERE page % 9 <> 0) SELECT coalesce(p.document, b.document) AS document, coalesce(p.page, b.page) AS page, round(abs(p.gray_stddev - b.g), 6) AS difference, CASE WHEN p.page IS NULL OR b.page IS NULL THEN 'PAGE_MISSING' ELSE 'PAGE_DIFFERS' END AS code FROM p FULL JOIN b ON p.document = b.document AND p.page = b.page WHERE p.page IS NULL OR b.page IS NULL OR round(abs(p.gray_stddev - b.g), 6) > 0.12")
def rendering_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Pages that differ between two renderings."""
    left = _page_metrics(spark, folder)
    right = left.where("page % 9 <> 0").withColumn("gray_stddev", F.col("gray_stddev") * 0.9 + 0.05)
    return pages.compare_renderings(left, right, ["document"], "gray_stddev")


@query("SELECT vec_id, round(list_avg(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS gray_mean, round(list_stddev_pop(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS gray_stddev FROM embeddings")
def pixel_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Mean and deviation of arrays of values."""
    return pages.pixel_statistics(table(spark, folder, "embeddings", "vec_id", "embedding"), ["vec_id"], "embedding")


@query(with_sql("items") + "SELECT document, upper(sha256(array_to_string(list_sort(list(coalesce(location, '') || chr(0) || coalesce(sha256, ''))), chr(0)))) AS fingerprint FROM items WHERE kind IN ('image', 'media') GROUP BY document")
def structure_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """M2, M3: digests over a package's sorted parts."""
    return templates.structure_fingerprint(_items(spark, folder).where("kind IN ('image', 'media')"), ["document"], "location")


@query("""
    WITH a AS (UNPIVOT (SELECT document, coalesce(family, '~') AS family, coalesce(lang, '~') AS lang, coalesce(CAST(page_count AS VARCHAR), '~') AS page_count FROM source_document) ON family, lang, page_count INTO NAME name VALUE value),
    b AS (SELECT document, name, CASE WHEN name = 'lang' AND value = 'en' THEN 'de' ELSE value END AS value FROM a WHERE NOT (name = 'page_count' AND value = '~'))
    SELECT a.document, a.name, CASE WHEN b.value IS NOT DISTINCT FROM nullif(a.value, '~') OR (b.value = '~' AND a.value = '~') THEN 'PASS' WHEN a.value = '~' AND b.value IS NULL THEN 'PASS' ELSE 'FAIL' END AS status FROM a LEFT JOIN b USING (document, name)
""")
def fact_differences(spark: SparkSession, folder: str) -> DataFrame:
    """Facts unpivoted and compared, nulls equal to nulls."""
    left = templates.unpivoted(table(spark, folder, "source_document"), "document", ["family", "lang", "page_count"])
    right = left.withColumn("value", F.when((F.col("name") == "lang") & (F.col("value") == "en"), "de").otherwise(F.col("value")))
    return templates.differences(left, right, ["document"]).select("document", "name", "status")


@query("""
    WITH p AS (SELECT document AS reference, family AS structure_sha, lang AS visual_sha FROM source_document WHERE page_count <= 3), r AS (SELECT document AS request, family AS structure_sha, lang AS visual_sha FROM source_document WHERE page_count = 4)
    SELECT request, reference, CASE WHEN coalesce(r.structure_sha = p.structure_sha, false) AND coalesce(r.visual_sha = p.visual_sha, false) THEN 1.0 ELSE 0.75 END AS score FROM r JOIN p ON r.structure_sha = p.structure_sha OR r.visual_sha = p.visual_sha
""")
def template_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """Packs of the same structure or look."""
    rows = table(spark, folder, "source_document", "document", "family", "lang", "page_count")
    packs = rows.where("page_count <= 3").select(F.col("document").alias("reference"), F.col("family").alias("structure_sha"), F.col("lang").alias("visual_sha"))
    asked = rows.where("page_count = 4").select(F.col("document").alias("request"), F.col("family").alias("structure_sha"), F.col("lang").alias("visual_sha"))
    return templates.similar_templates(asked, packs)


@query("SELECT document, CASE WHEN n = 0 THEN false WHEN n = 1 THEN family = 'word' ELSE family = 'word' AND coalesce(lang IN ('en', 'zh'), false) END AS matches FROM (SELECT document, family, lang, CASE WHEN coalesce(page_count, 0) % 3 = 0 THEN 0 WHEN coalesce(page_count, 0) % 3 = 1 THEN 1 ELSE 2 END AS n FROM source_document)")
def route_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Routing rules over a context."""
    rows = table(spark, folder, "source_document", "document", "family", "lang", "page_count")
    rule = lambda field, op, value, values: F.struct(F.lit(field).alias("field"), F.lit(op).alias("operator"), F.lit(value).cast("string").alias("value"), F.array(*map(F.lit, values)).cast("array<string>").alias("values"))
    one, two = rule("family", "equals", "word", []), rule("lang", "in", None, ["en", "zh"])
    n = F.coalesce("page_count", F.lit(0)) % 3
    rules = F.when(n == 0, F.slice(F.array(one), 2, 1)).when(n == 1, F.array(one)).otherwise(F.array(one, two))
    context = F.create_map(F.lit("family"), F.col("family"), F.lit("lang"), F.col("lang"))
    return rows.select("document", F.coalesce(templates.route_matches(rules, context, F.lit(False)), F.lit(False)).alias("matches"))


@query(with_sql("items") + "SELECT document, source_part AS part, string_agg(DISTINCT relationship_id, ',' ORDER BY relationship_id) AS relationship_ids FROM items WHERE kind = 'relationship' AND source_part IS NOT NULL GROUP BY ALL")
def part_relationships(spark: SparkSession, folder: str) -> DataFrame:
    """the relationships of each part."""
    return templates.part_relationships(_items(spark, folder).where("kind = 'relationship'"), "document")


@query(with_sql("items", "headings") + ", n AS (SELECT document, ordinal, title, count(*) OVER (PARTITION BY document) AS n, row_number() OVER (PARTITION BY document ORDER BY ordinal) AS nth FROM headings) SELECT document, ordinal, CASE WHEN n = 1 THEN 'body' WHEN nth = 1 THEN 'cover' WHEN nth = n THEN 'closing' ELSE 'body' END AS area FROM n")
def region_areas(spark: SparkSession, folder: str) -> DataFrame:
    """M4: cover, body and closing."""
    return templates.classify_regions(derived.headings(_items(spark, folder)), "document", "ordinal").select("document", "ordinal", "area")


@query(r"SELECT row_id, regexp_matches(text, '(?i)X{2,}|[ＸＸ]{2,}|产品全称|产品型号|型号|待填|请输入') AS slot, contains(text, 'XXX') OR contains(text, 'XX') OR contains(text, '待核实') OR contains(text, 'TBD') OR contains(text, 'TODO') OR contains(text, '请输入') OR contains(text, '此处文件为产品示例图片') AS visible FROM inventory_item WHERE kind = 'text' AND text IS NOT NULL")
def placeholder_slots(spark: SparkSession, folder: str) -> DataFrame:
    """Slots of templates and visible placeholders."""
    rows = table(spark, folder, "inventory_item", "row_id", "kind", "text").where("kind = 'text' AND text IS NOT NULL")
    return rows.select("row_id", F.col("text").rlike(patterns.PLACEHOLDER_SLOT).alias("slot"), patterns.contains_any(F.col("text"), patterns.PLACEHOLDERS).alias("visible"))


@query(f"SELECT title, count(*) AS n, count(DISTINCT document) AS documents FROM (SELECT document, regexp_replace(text, '{SP}|[▌▎]', '', 'g') AS title FROM inventory_item WHERE kind = 'text' AND regexp_matches(text, '^[0-9]{{1,2}}\\.[0-9]{{1,2}} ')) GROUP BY title")
def heading_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Headings compared without spaces."""
    rows = table(spark, folder, "inventory_item", "document", "kind", "text").where((F.col("kind") == "text") & F.col("text").rlike(r"^[0-9]{1,2}\.[0-9]{1,2} "))
    return rows.groupBy(text.title_token(F.col("text")).alias("title")).agg(F.count("*").alias("n"), F.countDistinct("document").alias("documents"))


@query("""
    SELECT document, coalesce(family, '-') || '/' || coalesce(lang, '-') AS bad FROM source_document WHERE family NOT IN ('word', 'presentation', 'fixed_layout') OR length(lang) > 2 OR page_count < 2
""")
def schema_violations(spark: SparkSession, folder: str) -> DataFrame:
    """L1: a JSON schema compiled to columns."""
    rows = table(spark, folder, "source_document", "document", "family", "lang", "page_count")
    schema = {"properties": {"family": {"enum": ["word", "presentation", "fixed_layout"]}, "lang": {"maxLength": 2}, "page_count": {"minimum": 2}}}
    errors = validation.schema_errors(F.struct("family", "lang", "page_count"), schema)
    return rows.where(F.size(errors) > 0).select("document", F.concat(F.coalesce("family", F.lit("-")), F.lit("/"), F.coalesce("lang", F.lit("-"))).alias("bad"))


@query(r"""
    WITH lines AS (SELECT doc_id, lang, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents), s AS (SELECT lang, line, len(regexp_extract_all(line, '[0-9]+(?:\.[0-9]+)? ?%')) AS percents, regexp_matches(line, '(?i)(?:^|[^a-z])shall|must|应|必须') AS rule FROM lines WHERE trim(line) <> '')
    SELECT coalesce(lang, '-') AS lang, count(*) AS lines, sum(percents)::BIGINT AS percents, count(*) FILTER (rule) AS rules, count(*) FILTER (percents = 0 AND NOT rule) AS unresolved FROM s GROUP BY 1
""")
def signal_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship: per language, lines with signals and what stays unresolved."""
    rows = table(spark, folder, "documents", "doc_id", "lang", "text").select("lang", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line")).where(F.trim("line") != "")
    rows = rows.withColumn("percents", F.regexp_count("line", F.lit(r"[0-9]+(?:\.[0-9]+)? ?%"))).withColumn("rule", F.col("line").rlike(r"(?i)(?:^|[^a-z])shall|must|应|必须"))
    return rows.groupBy(F.coalesce("lang", F.lit("-")).alias("lang")).agg(F.count("*").alias("lines"), F.sum("percents").alias("percents"), F.count_if("rule").alias("rules"), F.count_if((F.col("percents") == 0) & ~F.col("rule")).alias("unresolved"))
