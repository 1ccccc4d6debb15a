"""Further queries: decided content, previews, paths, reviews, and names of outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.functions import grids, text
from docweft.operators import cache, content, coverage, groups, items, redaction, templates, validation
from docweft.plans import derived
from docweft.plans.derived import with_sql
from docweft.plans.queries import SP, _items, _norm, query
from docweft.sources.tables import table


@query("SELECT row_id, CASE WHEN n = 1 THEN v END AS action, n > 1 AS contradicts FROM (SELECT row_id, len(l) AS n, l[1] AS v FROM (SELECT row_id, list_distinct(list_filter([trim(kind), trim(CASE WHEN row_id % 3 = 0 THEN NULL WHEN row_id % 3 = 1 THEN kind ELSE 'other' END), trim(CASE WHEN row_id % 2 = 0 THEN ' ' END)], lambda a: a <> '')) AS l FROM inventory_item))")
def alias_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Aliases of an action that must agree."""
    rows = table(spark, folder, "inventory_item", "row_id", "kind")
    second = F.when(F.col("row_id") % 3 == 1, F.col("kind")).when(F.col("row_id") % 3 == 2, F.lit("other"))
    value, bad = content.agreed(F.col("kind"), second, F.when(F.col("row_id") % 2 == 0, F.lit(" ")))
    return rows.select("row_id", value.alias("action"), bad.alias("contradicts"))


@query("SELECT row_id, coalesce(region IN ('slide_master', 'slide_layout', 'notes_master'), false) OR (coalesce(region IN ('slide', 'notes'), false) AND kind = 'shape_description' AND coalesce(trim(title), '') = '' AND coalesce(trim(description), '') = '') AS structural FROM inventory_item")
def structural_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Items that only carry structure."""
    rows = table(spark, folder, "inventory_item", "row_id", "kind", "region", "title", "description")
    return rows.select("row_id", content.is_structural(*(F.col(c) for c in ("kind", "region", "title", "description"))).alias("structural"))


_BLOCKS = "CASE WHEN ordinal % 5 = 0 THEN [{'text': 'first ' || source_id, 'target_slot': NULL, 'target_order': 7}, {'text': NULL, 'target_slot': 'slot-x', 'target_order': NULL}] END"


@query(with_sql("items") + f", d AS (SELECT document, source_id, kind AS reviewed_text, 'slot-' || (ordinal % 7) AS target_slot, ordinal AS target_order, {_BLOCKS} AS b FROM items), e AS (SELECT *, unnest(CASE WHEN b IS NULL THEN [NULL] ELSE range(0, 2) END) AS block_index FROM d) SELECT document, source_id, block_index, coalesce(b[block_index + 1].text, reviewed_text) AS text, coalesce(b[block_index + 1].target_slot, target_slot) AS target_slot, coalesce(b[block_index + 1].target_order, target_order) AS target_order FROM e")
def reviewed_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """C14: decisions flattened to their reviewed blocks."""
    kind = "array<struct<text:string,target_slot:string,target_order:int>>"
    two = F.array(F.struct(F.concat(F.lit("first "), "source_id").alias("text"), F.lit(None).cast("string").alias("target_slot"), F.lit(7).alias("target_order")), F.struct(F.lit(None).cast("string").alias("text"), F.lit("slot-x").alias("target_slot"), F.lit(None).cast("int").alias("target_order"))).cast(kind)
    rows = _items(spark, folder).select("document", "source_id", F.col("kind").alias("reviewed_text"), F.concat(F.lit("slot-"), (F.col("ordinal") % 7).cast("string")).alias("target_slot"), F.col("ordinal").alias("target_order"), F.when(F.col("ordinal") % 5 == 0, two).alias("reviewed_blocks"))
    return content.blocks(rows, ["document", "source_id"])


@query("SELECT p_partkey, round(w * s, 3) AS width, round(h * s, 3) AS height FROM (SELECT p_partkey, w, h, least(1.0, 6.5 / w, 8.0 / h) AS s FROM (SELECT p_partkey, p_size / 2.0 AS w, p_retailprice / 100.0 AS h FROM part WHERE p_size > 0 AND p_retailprice > 0))")
def display_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes scaled down to a box."""
    rows = table(spark, folder, "part", "p_partkey", "p_size", "p_retailprice").where("p_size > 0 AND p_retailprice > 0")
    return rows.select("p_partkey", grids.fitted(F.col("p_size") / 2.0, F.col("p_retailprice") / 100.0, 6.5, 8.0).alias("s")).select("p_partkey", F.round("s.width", 3).alias("width"), F.round("s.height", 3).alias("height"))


@query("SELECT l_partkey AS image, CAST(s.w AS DOUBLE) AS width, CAST(s.h AS DOUBLE) AS height FROM (SELECT l_partkey, min({'a': l_quantity * l_extendedprice, 'w': l_quantity, 'h': l_extendedprice}) AS s FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0 GROUP BY l_partkey)")
def smallest_occurrence(spark: SparkSession, folder: str) -> DataFrame:
    """The smallest of a picture's occurrences."""
    rows = table(spark, folder, "lineitem", "l_partkey", "l_quantity", "l_extendedprice")
    return items.smallest_size(rows.select(F.col("l_partkey").alias("image"), F.col("l_quantity").alias("width"), F.col("l_extendedprice").alias("height")), "image")


@query(r"SELECT evidence_id, path, path IS NOT NULL AND path <> '' AND NOT regexp_matches(path, '^[A-Za-z]:|^[/\\]|\\|[\x00-\x1f]|://') AND len(list_filter(string_split(path, '/'), lambda x: x = '' OR x = '.' OR x = '..' OR regexp_matches(x, '(?i)^(?:con|prn|aux|nul|com[1-9]|lpt[1-9])(?:\..*)?$') OR regexp_matches(x, '[. ]$'))) = 0 AS safe FROM (SELECT evidence_id, CASE substring(evidence_id, 7, 1) WHEN '0' THEN '../' || path WHEN '1' THEN '/' || path WHEN '2' THEN 'C:/' || path WHEN '3' THEN replace(path, '/', '\') WHEN '4' THEN path || '/nul.txt' WHEN '5' THEN path || ' ' WHEN '6' THEN NULL ELSE path END AS path FROM evidence)")
def safe_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Paths that stay inside of their folder."""
    digit, path = F.substring("evidence_id", 7, 1), F.col("path")
    broken = F.when(digit == "0", F.concat(F.lit("../"), path)).when(digit == "1", F.concat(F.lit("/"), path)).when(digit == "2", F.concat(F.lit("C:/"), path)).when(digit == "3", F.replace(path, F.lit("/"), F.lit("\\"))).when(digit == "4", F.concat(path, F.lit("/nul.txt"))).when(digit == "5", F.concat(path, F.lit(" "))).when(digit == "6", F.lit(None)).otherwise(path)
    return table(spark, folder, "evidence", "evidence_id", "path").select("evidence_id", broken.alias("path")).select("evidence_id", "path", content.is_safe_path(F.col("path")).alias("safe"))


@query(with_sql("items", "decisions") + ", s AS (SELECT unnest(range(0, 9)) AS k), p AS (SELECT document, target_slot, count(*) AS n FROM decisions WHERE action IN ('preserve_exact', 'preserve_image', 'preserve_sanitized_image', 'redact_identity', 'reviewed_text') GROUP BY ALL) SELECT d.document, 'slot-' || k AS target_slot, coalesce(n, 0) AS n FROM (SELECT DISTINCT document FROM decisions) d CROSS JOIN s LEFT JOIN p ON p.document = d.document AND p.target_slot = 'slot-' || k")
def section_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Placed content by section, empty sections with 0."""
    sections = spark.range(9).select(F.concat(F.lit("slot-"), F.col("id").cast("string")).alias("target_slot"))
    return content.section_counts(derived.decisions(_items(spark, folder)), sections, ["document"], "target_slot")


@query(with_sql("items") + ", s AS (SELECT * FROM (VALUES ('text', 1), ('table', 2), ('video', 3)) t(kind, place)), g AS (SELECT document, kind, count(*) AS blocks FROM items GROUP BY ALL), e AS (SELECT document, s.kind, s.place FROM (SELECT DISTINCT document FROM items) d CROSS JOIN s) SELECT coalesce(e.document, g.document) AS document, coalesce(e.kind, g.kind) AS kind, row_number() OVER (PARTITION BY coalesce(e.document, g.document) ORDER BY place NULLS LAST, coalesce(e.kind, g.kind)) AS place, coalesce(blocks, 0) AS blocks, CASE WHEN blocks IS NULL THEN 'nothing here' ELSE '' END AS filler FROM e FULL JOIN g ON e.document = g.document AND e.kind = g.kind")
def preview_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Sections of a preview in template order."""
    sections = spark.createDataFrame([("text", 1), ("table", 2), ("video", 3)], "kind string, place int")
    return content.preview(_items(spark, folder), sections, ["document"], "kind", [], "nothing here")


@query(with_sql("items") + ", b AS (SELECT document, count(*) AS n, sum(length(coalesce(text, ''))) AS chars FROM items WHERE right(source_id, 1) = 'D' GROUP BY document) SELECT count(*) AS documents, sum(n)::BIGINT AS open_items, sum(chars)::BIGINT AS chars FROM b")
def prompt_accounting(spark: SparkSession, folder: str) -> DataFrame:
    """What is left to decide, in total."""
    rows = _items(spark, folder).where(F.right("source_id", F.lit(1)) == "D").groupBy("document").agg(F.count("*").alias("n"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
    return rows.agg(F.count("*").alias("documents"), F.sum("n").alias("open_items"), F.sum("chars").alias("chars"))


@query(f"SELECT DISTINCT a.document, a.row_id FROM inventory_item a WHERE a.kind = 'text' AND {_norm('a.text')} <> '' AND row_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM inventory_item b WHERE b.kind = 'text' AND b.row_id % 2 = 1 AND b.document = a.document AND {_norm('b.text')} = {_norm('a.text')})")
def missing_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """F8: expected texts that an output lacks."""
    rows = table(spark, folder, "inventory_item", "document", "row_id", "kind", "text").where("kind = 'text'")
    return content.missing_outputs(rows.where("row_id % 2 = 0"), rows.where("row_id % 2 = 1"), ["document"], "text").where("document IS NOT NULL").select("document", "row_id").distinct()


@query("SELECT document, relationship_id, count(*) AS n, string_agg(DISTINCT source_part, ',' ORDER BY source_part) AS parts FROM inventory_item WHERE relationship_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids used more than once, with their parts."""
    found = content.parts_of_duplicates(table(spark, folder, "inventory_item", "document", "relationship_id", "source_part"), ["document"], "relationship_id", "source_part")
    return found.withColumn("parts", F.when(F.col("parts") != "", F.col("parts")))


@query("WITH t AS (SELECT kind, count(*) AS required FROM inventory_item WHERE row_id % 3 <> 0 GROUP BY kind), d AS (SELECT kind, count(*) AS present FROM inventory_item WHERE row_id % 3 = 0 AND kind <> 'other' GROUP BY kind) SELECT kind, required, coalesce(present, 0) AS present FROM t LEFT JOIN d USING (kind) WHERE coalesce(present, 0) < required")
def fewer_than_template(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds that are less frequent than in the template."""
    rows = table(spark, folder, "inventory_item", "row_id", "kind")
    return content.fewer_than_template(rows.where("row_id % 3 <> 0"), rows.where("row_id % 3 = 0 AND kind <> 'other'"), "kind")


_WANTED = "(VALUES ('Product overview', 1), ('Installation', 2), ('Maintenance', 3)) e(title, place)"


@query(with_sql("items") + rf", h AS (SELECT document, ordinal, regexp_replace(text, '^[0-9.]+ ', '') AS title FROM items WHERE kind = 'text' AND regexp_matches(text, '^[0-9]{{1,2}}\.[0-9]{{1,2}} ')), g AS (SELECT document, title, count(*) AS n, min(ordinal) AS pos FROM h GROUP BY ALL), s AS (SELECT d.document, e.title, e.place, n, pos FROM (SELECT DISTINCT document FROM h) d CROSS JOIN {_WANTED} LEFT JOIN g ON g.document = d.document AND g.title = e.title), b AS (SELECT *, max(pos) OVER (PARTITION BY document ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s) SELECT document, title, CASE WHEN n IS NULL THEN 'TITLE_MISSING' WHEN n > 1 THEN 'TITLE_DOUBLED' ELSE 'TITLE_OUT_OF_ORDER' END AS code FROM b WHERE n IS NULL OR n > 1 OR pos < before")
def title_order(spark: SparkSession, folder: str) -> DataFrame:
    """Expected titles missing, doubled or out of order."""
    rows = derived.headings(_items(spark, folder)).withColumn("title", F.regexp_replace("title", "^[0-9.]+ ", ""))
    wanted = spark.createDataFrame([("Product overview", 1), ("Installation", 2), ("Maintenance", 3)], "title string, place int")
    return content.titles_out_of_order(rows, wanted, "document", "ordinal", "title")


@query()
def title_subsequences(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a document's first titles keep their order in all of its texts."""
    rows = _items(spark, folder).where("kind = 'text' AND text IS NOT NULL")
    return groups.ordered_subsequence(groups.first_of(derived.headings(rows), ["document"], ["ordinal"], 3).withColumnRenamed("title", "text"), rows, "document", "ordinal", "text")


@query("WITH f AS (SELECT 't' || (row_id % 3) AS task_id, source_id FROM inventory_item WHERE row_id % 4 <> 0), t AS (SELECT DISTINCT 't' || (row_id % 3) AS task_id, source_id FROM inventory_item WHERE row_id % 7 <> 0) SELECT source_id, 'DECIDED_TWICE' AS code FROM f GROUP BY source_id HAVING count(*) > 1 UNION ALL SELECT DISTINCT source_id, 'NOT_IN_TASK' FROM f WHERE (task_id, source_id) NOT IN (SELECT (task_id, source_id) FROM t)")
def fragment_findings(spark: SparkSession, folder: str) -> DataFrame:
    """What breaks a union of partial results."""
    rows = table(spark, folder, "inventory_item", "row_id", "source_id").withColumn("task_id", F.concat(F.lit("t"), (F.col("row_id") % 3).cast("string")))
    return coverage.union_fragments(rows.where("row_id % 4 <> 0"), rows.where("row_id % 7 <> 0").select("task_id", "source_id").distinct(), ["source_id"])


@query(with_sql("items", "decisions") + f", j AS (SELECT d.document, d.source_id, d.action, i.text, i.kind FROM decisions d JOIN items i USING (document, source_id)) SELECT document, source_id, sha256(CASE action WHEN 'preserve_exact' THEN {_norm('text')} WHEN 'redact_identity' THEN trim(regexp_replace(replace(coalesce(text, ''), 'gasket', ''), '{SP}+', ' ', 'g')) WHEN 'reviewed_text' THEN {_norm('kind')} END) AS digest FROM j")
def expected_texts(spark: SparkSession, folder: str) -> DataFrame:
    """K3: the text that each decision lets through."""
    rows = _items(spark, folder)
    joined = derived.decisions(rows).join(rows.select("document", "source_id", "text", "kind"), ["document", "source_id"])
    return joined.select("document", "source_id", F.sha2(redaction.expected_text(F.col("action"), F.col("text"), F.col("kind"), F.array(F.lit("gasket"))), 256).alias("digest"))


@query("SELECT document, CASE WHEN family IS NULL THEN 'FAMILY_MISSING' WHEN family <> CASE detected_format WHEN 'docx' THEN 'word' WHEN 'doc' THEN 'word' WHEN 'pptx' THEN 'presentation' WHEN 'ppt' THEN 'presentation' ELSE 'fixed_layout' END THEN 'FAMILY_MISMATCH' WHEN page_count IS NULL THEN 'PAGES_UNKNOWN' END AS code FROM source_document WHERE family IS NULL OR page_count IS NULL OR family <> CASE detected_format WHEN 'docx' THEN 'word' WHEN 'doc' THEN 'word' WHEN 'pptx' THEN 'presentation' WHEN 'ppt' THEN 'presentation' ELSE 'fixed_layout' END")
def probe_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """L2: facts of a document that must agree with its probe."""
    return validation.probe_agreement(table(spark, folder, "source_document", "document", "family", "detected_format", "page_count"), "document")


@query("SELECT row_id, CASE WHEN len(rows) = 0 THEN 'TABLE_EMPTY' WHEN list_min(list_transform(rows, lambda r: len(coalesce(r, [])))) <> list_max(list_transform(rows, lambda r: len(coalesce(r, [])))) THEN 'TABLE_RAGGED' END AS code FROM inventory_item WHERE kind = 'table' AND rows IS NOT NULL AND (len(rows) = 0 OR list_min(list_transform(rows, lambda r: len(coalesce(r, [])))) <> list_max(list_transform(rows, lambda r: len(coalesce(r, [])))))")
def table_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Empty and ragged tables."""
    widths = F.transform(grids.text_rows(F.col("rows")), F.size)
    code = F.when(F.size("rows") == 0, "TABLE_EMPTY").when(F.array_min(widths) != F.array_max(widths), "TABLE_RAGGED")
    return table(spark, folder, "inventory_item", "row_id", "kind", "rows").where("kind = 'table' AND rows IS NOT NULL").select("row_id", code.alias("code")).where("code IS NOT NULL")


@query("WITH a AS (SELECT review_id, unnest([{'n': 'status', 'v': status}, {'n': 'notes', 'v': notes}, {'n': 'document', 'v': document}]) AS f FROM identity_review), b AS (SELECT review_id, f.n AS name, CASE WHEN review_id % 3 = 0 AND f.n = 'notes' THEN 'changed' WHEN review_id % 5 = 0 AND f.n = 'status' THEN 'changed' ELSE f.v END AS after, f.v AS before FROM a) SELECT review_id, name, name = 'notes' AS allowed FROM b WHERE before IS DISTINCT FROM after")
def changed_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Fields that changed, and whether they may."""
    rows = table(spark, folder, "identity_review", "review_id", "status", "notes", "document")
    facts = rows.select("review_id", F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in ("status", "notes", "document")))).alias("f")).select("review_id", "f.name", "f.value")
    changed = F.when((F.col("review_id") % 3 == 0) & (F.col("name") == "notes"), "changed").when((F.col("review_id") % 5 == 0) & (F.col("name") == "status"), "changed").otherwise(F.col("value"))
    return validation.changed_fields(facts, facts.withColumn("value", changed), "review_id", ("notes",))


@query(with_sql("items", "decisions") + ", f AS (SELECT document, source_id, CASE WHEN confidence IS NULL OR confidence < 0 OR confidence > 1 THEN 'CONFIDENCE_INVALID' ELSE 'LOW_CONFIDENCE' END AS category FROM decisions WHERE confidence IS NULL OR confidence < 0 OR confidence > 1 OR confidence < 0.8), g AS (SELECT document, category, string_agg(DISTINCT source_id, ',' ORDER BY source_id) AS s, count(DISTINCT source_id) AS sources FROM f GROUP BY ALL) SELECT document, category, sources, 'REVIEW-' || substring(upper(sha256(document || chr(31) || category || chr(31) || s)), 1, 16) AS review_item_id FROM g")
def review_queue(spark: SparkSession, folder: str) -> DataFrame:
    """Items to review with ids over their members."""
    found = validation.decision_findings(derived.decisions(_items(spark, folder)), ["document", "source_id"])
    return content.review_items(found, ["document"], "code", "source_id")


@query(with_sql("items") + "SELECT document, row_id, page || '/' || dense_rank() OVER (PARTITION BY document, page ORDER BY kind NULLS FIRST) || '/' || row_number() OVER (PARTITION BY document, page, kind ORDER BY ordinal, source_id) AS target FROM items WHERE page IS NOT NULL")
def annotation_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Paths that annotations address."""
    rows = _items(spark, folder).where("page IS NOT NULL").select("document", "row_id", "page", "kind", F.struct("ordinal", "source_id").alias("o"), F.struct("document", "page").alias("p"))
    return content.annotation_targets(rows, "p", "kind", "o").select("document", "row_id", F.regexp_replace("target", r"^[^/]*/", F.concat(F.col("page").cast("string"), F.lit("/"))).alias("target"))


@query("WITH c AS (SELECT DISTINCT document, review_id, unnest(evidence_ids) AS e FROM identity_review WHERE document IS NOT NULL), n AS (SELECT document, e, count(*) AS reviews FROM c GROUP BY ALL) SELECT review_id, count(*) AS shared, max(reviews) AS most FROM c JOIN n USING (document, e) WHERE reviews > 1 GROUP BY review_id")
def overlapping_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Reviews that share evidence with others of their document: counted by evidence, without any pairs."""
    cited = table(spark, folder, "identity_review", "document", "review_id", "evidence_ids").where("document IS NOT NULL").select("document", "review_id", F.explode("evidence_ids").alias("e")).distinct()
    shared = cited.groupBy("document", "e").agg(F.count("*").alias("reviews")).where("reviews > 1")
    return cited.join(shared, ["document", "e"]).groupBy("review_id").agg(F.count("*").alias("shared"), F.max("reviews").alias("most"))


@query("SELECT upper(sha256('{\"in_family\":' || coalesce('\"' || family || '\"', 'null') || ',\"in_lang\":' || coalesce('\"' || lang || '\"', 'null') || ',\"stage\":\"inventory\"}')) AS key, document FROM source_document")
def cache_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of stages over their inputs."""
    rows = table(spark, folder, "source_document", "document", "family", "lang")
    return rows.select(cache.cache_key("inventory", {"lang": F.col("lang"), "family": F.col("family")}).alias("key"), "document")


@query("WITH m AS (SELECT document AS key, evidence_id AS member, any_value(sha256 ORDER BY sha256) AS sha256 FROM (SELECT document, evidence_id, min(sha256) AS sha256 FROM evidence GROUP BY ALL) GROUP BY ALL), h AS (SELECT key, member, CASE WHEN substring(member, 7, 2) = '00' THEN 'x' ELSE sha256 END AS sha256 FROM m WHERE substring(member, 7, 2) <> '01'), c AS (SELECT m.key, bool_and(m.sha256 IS NOT DISTINCT FROM h.sha256) AS whole FROM m LEFT JOIN h USING (key, member) GROUP BY m.key) SELECT s.document AS key, CASE WHEN whole IS NULL THEN 'MISS' WHEN whole THEN 'HIT' ELSE 'CORRUPT' END AS cache_status FROM source_document s LEFT JOIN c ON c.key = s.document")
def cache_lookups(spark: SparkSession, folder: str) -> DataFrame:
    """HIT, MISS or CORRUPT."""
    manifest = table(spark, folder, "evidence", "document", "evidence_id", "sha256").groupBy(F.col("document").alias("key"), F.col("evidence_id").alias("member")).agg(F.min("sha256").alias("sha256"))
    members = manifest.where(F.substring("member", 7, 2) != "01").withColumn("sha256", F.when(F.substring("member", 7, 2) == "00", "x").otherwise(F.col("sha256")))
    return cache.lookup(table(spark, folder, "source_document", "document").withColumnRenamed("document", "key"), manifest, members)


@query("SELECT lower(family) AS family, count(DISTINCT lower(lang)) AS paths FROM source_document WHERE page_count > 1 GROUP BY 1 HAVING count(DISTINCT lower(lang)) > 1")
def conflicting_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Keys with several different valid values."""
    return content.conflicting_candidates(table(spark, folder, "source_document", "family", "lang", "page_count").withColumn("valid", F.col("page_count") > 1), "family", "lang", "valid")


@query("SELECT document, CASE WHEN page_count % 2 = 0 THEN 'run --out ' || file_name || ' -v' ELSE 'run -v --out ' || file_name END AS command FROM source_document WHERE page_count IS NOT NULL")
def rebound_commands(spark: SparkSession, folder: str) -> DataFrame:
    """M20d: a flag's value replaced or appended."""
    rows = table(spark, folder, "source_document", "document", "file_name", "page_count").where("page_count IS NOT NULL")
    command = F.when(F.col("page_count") % 2 == 0, F.array(F.lit("run"), F.lit("--out"), F.lit("old"), F.lit("-v"))).otherwise(F.array(F.lit("run"), F.lit("-v")))
    return rows.select("document", F.array_join(content.rebound(command, "--out", F.col("file_name")), " ").alias("command"))


@query(r"WITH e AS (SELECT DISTINCT regexp_replace(file_name, '\.[^.]+$', '') AS name FROM source_document), w AS (SELECT DISTINCT regexp_replace(name, '-v[0-9]{1,9}$', '') AS stem FROM (SELECT name FROM e UNION ALL SELECT 'fresh')), t AS (SELECT regexp_replace(name, '-v[0-9]{1,9}$', '') AS stem, max(coalesce(try_cast(regexp_extract(name, '-v([0-9]{1,9})$', 1) AS INTEGER), 1)) AS v FROM e GROUP BY 1) SELECT stem, CASE WHEN v IS NULL THEN stem ELSE stem || '-v' || (v + 1) END AS name FROM w LEFT JOIN t USING (stem)")
def next_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Free names for outputs."""
    names = table(spark, folder, "source_document", "file_name").select(F.regexp_replace("file_name", r"\.[^.]+$", "").alias("name")).distinct()
    wanted = names.unionByName(spark.createDataFrame([("fresh",)], "name string")).select(F.regexp_replace("name", r"-v\d{1,9}$", "").alias("stem"))
    return content.next_versions(names, wanted, "stem")


@query("SELECT 0 AS check_ordinal, document, 'LANG_MISSING' AS code FROM source_document WHERE lang IS NULL UNION ALL SELECT 1, document, 'PAGES_MISSING' FROM source_document WHERE page_count IS NULL UNION ALL SELECT 2, document, 'MANY_PAGES' FROM source_document WHERE page_count > 20")
def ordered_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Independent checks in one table with a stable order."""
    rows = table(spark, folder, "source_document", "document", "lang", "page_count")
    find = lambda condition, code: rows.where(condition).select("document", F.lit(code).alias("code"))
    return content.ordered_union(find("lang IS NULL", "LANG_MISSING"), find("page_count IS NULL", "PAGES_MISSING"), find("page_count > 20", "MANY_PAGES"))


@query("SELECT document, file_name IS NOT NULL AND count(*) OVER (PARTITION BY lower(file_name)) = 1 AS unique_name FROM source_document")
def catalog_uniqueness(spark: SparkSession, folder: str) -> DataFrame:
    """Entries that exactly one name resolves to."""
    return templates.uniquely_named(table(spark, folder, "source_document", "document", "file_name"), "document", "file_name")


@query(f"SELECT document, count(DISTINCT {_norm('text')}) FILTER ({_norm('text')} <> '') AS texts, count(DISTINCT upper(sha256)) AS digests, count(DISTINCT upper(visual_sha256)) AS looks FROM inventory_item GROUP BY document")
def output_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """What a document holds: different texts, media and pictures."""
    return content.output_evidence(table(spark, folder, "inventory_item", "document", "text", "sha256", "visual_sha256"), "document")


@query()
def fact_sensitive(spark: SparkSession, folder: str) -> DataFrame:
    """Texts whose facts need a second look (look-behind has no counterpart in the other engine)."""
    rows = table(spark, folder, "inventory_item", "row_id", "kind", "text", "extraction").where("kind = 'text'")
    return rows.select("row_id", content.is_fact_sensitive(F.col("text"), F.col("extraction")).alias("sensitive"))


# ---- further checks ----------------------------------------------------------------------------------------------


@query("WITH e AS (SELECT row_id, CASE row_id % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE text END AS reviewed_text, CASE row_id % 7 WHEN 0 THEN ' ' ELSE 'r' END AS reviewer, source_id, CASE row_id % 4 WHEN 0 THEN [] WHEN 1 THEN [source_id] WHEN 2 THEN ['ghost'] ELSE ['ghost', source_id] END AS ev FROM inventory_item WHERE kind = 'text') SELECT row_id, 'REVIEWED_TEXT_EMPTY' AS code FROM e WHERE coalesce(trim(reviewed_text), '') = '' UNION ALL SELECT row_id, 'REVIEWER_MISSING' FROM e WHERE trim(reviewer) = '' UNION ALL SELECT row_id, 'EVIDENCE_MISSING' FROM e WHERE len(ev) = 0 UNION ALL SELECT row_id, 'OWN_SOURCE_NOT_CITED' FROM e WHERE len(ev) > 0 AND NOT list_contains(ev, source_id) UNION ALL SELECT row_id, 'EVIDENCE_UNKNOWN' FROM e WHERE list_contains(ev, 'ghost')")
def reviewed_text_findings(spark: SparkSession, folder: str) -> DataFrame:
    """K4: reviewed texts whose evidence doesn't hold."""
    rows = table(spark, folder, "inventory_item", "row_id", "kind", "source_id", "text").where("kind = 'text'")
    cited = F.when(F.col("row_id") % 4 == 0, F.array().cast("array<string>")).when(F.col("row_id") % 4 == 1, F.array("source_id")).when(F.col("row_id") % 4 == 2, F.array(F.lit("ghost"))).otherwise(F.array(F.lit("ghost"), F.col("source_id")))
    entries = rows.select("row_id", "source_id", F.when(F.col("row_id") % 5 == 0, "").when(F.col("row_id") % 5 != 1, F.col("text")).alias("reviewed_text"), F.when(F.col("row_id") % 7 == 0, " ").otherwise("r").alias("reviewer"), cited.alias("evidence_sources"))
    return validation.reviewed_text_findings(entries, rows.select("source_id"), ["row_id"])


@query(r"WITH e AS (SELECT row_id, kind, sha256, CASE row_id % 3 WHEN 0 THEN '../x.png' WHEN 1 THEN 'a/x.png' END AS p, CASE row_id % 4 WHEN 0 THEN upper(sha256) WHEN 1 THEN 'short' ELSE upper(sha256('new' || row_id)) END AS s, CASE row_id % 2 WHEN 0 THEN 'ok' END AS note FROM inventory_item WHERE kind IN ('image', 'media')) SELECT row_id, 'REPLACEMENT_KIND_INVALID' AS code FROM e WHERE kind <> 'image' UNION ALL SELECT row_id, 'REPLACEMENT_PATH_UNSAFE' FROM e WHERE p IS NULL OR p LIKE '..%' UNION ALL SELECT row_id, 'REPLACEMENT_HASH_INVALID' FROM e WHERE NOT regexp_matches(coalesce(s, ''), '^[0-9A-F]{64}$') UNION ALL SELECT row_id, 'REPLACEMENT_UNCHANGED' FROM e WHERE coalesce(s, '') = upper(coalesce(sha256, '?')) UNION ALL SELECT row_id, 'REVIEW_NOTE_MISSING' FROM e WHERE note IS NULL")
def replacement_findings(spark: SparkSession, folder: str) -> DataFrame:
    """K5: sanitized images by their metadata."""
    rows = table(spark, folder, "inventory_item", "row_id", "kind", "sha256").where("kind IN ('image', 'media')")
    r = F.col("row_id")
    new = F.upper(F.sha2(F.concat(F.lit("new"), r.cast("string")), 256))
    entries = rows.select(
        "row_id", "kind", "sha256", F.when(r % 3 == 0, "../x.png").when(r % 3 == 1, "a/x.png").alias("replacement_path"), F.when(r % 4 == 0, F.upper("sha256")).when(r % 4 == 1, "short").otherwise(new).alias("replacement_sha256"), F.when(r % 2 == 0, "ok").alias("review_note")
    )
    return validation.replacement_findings(entries, ["row_id"])


@query("WITH s AS (SELECT evidence_id AS name FROM evidence WHERE substring(evidence_id, 6, 1) IN ('0', '1', '2', '3', '4', '5')), r AS (SELECT DISTINCT evidence_id AS name FROM evidence WHERE substring(evidence_id, 6, 1) IN ('4', '5', '6', '7')) SELECT name, 'STATED_TWICE' AS code FROM s GROUP BY name HAVING count(*) > 1 UNION ALL SELECT DISTINCT name, 'UNEXPECTED' FROM s WHERE name NOT IN (SELECT name FROM r) UNION ALL SELECT name, 'MISSING' FROM r WHERE name NOT IN (SELECT name FROM s)")
def finding_sets(spark: SparkSession, folder: str) -> DataFrame:
    """A stated set that must equal the required one."""
    rows = table(spark, folder, "evidence", "evidence_id").withColumnRenamed("evidence_id", "name")
    digit = F.substring("name", 6, 1)
    return validation.set_differences(rows.where(digit.isin(*"012345")), rows.where(digit.isin(*"4567")), "name")


@query("WITH i AS (SELECT document, 't' || (row_id % 3) AS task_id, source_id, length(coalesce(text, '')) AS chars FROM inventory_item), b AS (SELECT document, task_id, count(*) + CASE WHEN task_id = 't1' THEN 1 ELSE 0 END AS items, sum(chars) + CASE WHEN task_id = 't2' THEN 1 ELSE 0 END AS chars FROM i GROUP BY document, task_id), r AS (SELECT document, task_id, count(*) AS n, sum(chars) AS c, count(DISTINCT source_id) AS d FROM i GROUP BY document, task_id), j AS (SELECT r.*, b.items, b.chars FROM r LEFT JOIN b USING (document, task_id)) SELECT document, task_id, 'ITEM_COUNT_WRONG' AS code FROM j WHERE items IS DISTINCT FROM n UNION ALL SELECT document, task_id, 'CHARS_WRONG' FROM j WHERE chars IS DISTINCT FROM c UNION ALL SELECT document, task_id, 'TOO_MANY_ITEMS' FROM j WHERE n > 40 UNION ALL SELECT document, task_id, 'TOO_MANY_CHARS' FROM j WHERE n > 1 AND c > 16000 UNION ALL SELECT document, task_id, 'ITEM_TWICE' FROM j WHERE d < n")
def bundle_self_check(spark: SparkSession, folder: str) -> DataFrame:
    """L3: bundles against their own accounting."""
    rows = table(spark, folder, "inventory_item", "document", "row_id", "source_id", "text").select("document", F.concat(F.lit("t"), (F.col("row_id") % 3).cast("string")).alias("task_id"), "source_id", F.length(F.coalesce("text", F.lit(""))).alias("chars"))
    stated = rows.groupBy("document", "task_id").agg(F.count("*").alias("items"), F.sum("chars").alias("chars"))
    stated = stated.select("document", "task_id", (F.col("items") + (F.col("task_id") == "t1").cast("int")).alias("items"), (F.col("chars") + (F.col("task_id") == "t2").cast("int")).alias("chars"))
    return validation.batch_findings(stated, rows, ["document", "task_id"], 40, 16_000)


@query("WITH l AS (SELECT document, location, CASE WHEN row_id % 50 = 0 THEN 'gone' ELSE upper(sha256) END AS digest FROM inventory_item WHERE kind = 'image'), i AS (SELECT DISTINCT document, location, upper(sha256) AS digest FROM inventory_item WHERE kind = 'image') SELECT l.document, bool_and(i.document IS NOT NULL) AS equivalent FROM l LEFT JOIN i ON l.document = i.document AND l.location = i.location AND l.digest = i.digest GROUP BY l.document")
def legacy_equivalence(spark: SparkSession, folder: str) -> DataFrame:
    """whether all old entries still meet their item."""
    rows = table(spark, folder, "inventory_item", "document", "row_id", "kind", "location", "sha256").where("kind = 'image'").withColumn("digest", F.upper("sha256"))
    return validation.equivalent(rows.withColumn("digest", F.when(F.col("row_id") % 50 == 0, "gone").otherwise(F.col("digest"))).select("document", "location", "digest"), rows, ["document"])


@query("SELECT document, term, CAST(sum((length(lower(text)) - length(replace(lower(text), lower(term), ''))) / length(term)) AS BIGINT) AS hits, CASE WHEN term = 'gasket' THEN 'APPROVED' ELSE 'FINDING' END AS status FROM inventory_item, (VALUES ('Tulurbrask'), ('gasket'), ('控制板')) t(term) WHERE contains(lower(text), lower(term)) GROUP BY ALL")
def identity_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Identity terms left in a document, approved ones marked."""
    from docweft.operators import signals

    rows = table(spark, folder, "inventory_item", "document", "row_id", "text")
    terms = spark.createDataFrame([("Tulurbrask",), ("gasket",), ("控制板",)], "term string")
    found = signals.identity_scan(rows, terms, spark.createDataFrame([("Gasket ",)], "term string"), ["document", "row_id"], strict=False)
    return found.groupBy("document", "term", "status").agg(F.sum("hits").alias("hits"))


@query(with_sql("items") + "SELECT document, row_number() OVER (PARTITION BY document ORDER BY g, target, op) AS ordinal, op, target FROM (SELECT DISTINCT document, 0 AS g, 'retain_part' AS op, source_part AS target FROM items WHERE kind = 'relationship' AND source_part IS NOT NULL UNION ALL SELECT document, 1, CASE WHEN kind = 'image' THEN 'insert_image' WHEN kind = 'table' THEN 'insert_table' ELSE 'insert_text' END, source_id FROM items WHERE kind IN ('image', 'table'))")
def conservative_programs(spark: SparkSession, folder: str) -> DataFrame:
    """M5: programs that keep parts and bind slots."""
    from docweft.operators import templates

    rows = _items(spark, folder)
    parts = rows.where("kind = 'relationship' AND source_part IS NOT NULL").select("document", F.col("source_part").alias("part")).distinct()
    return templates.conservative_program(rows.where("kind IN ('image', 'table')").select("document", "kind", F.col("source_id").alias("slot_id")), parts, "document")


@query("SELECT document, count(*) AS members, sum(bytes)::BIGINT AS bytes, CASE WHEN count(*) FILTER (regexp_matches(lower(name), 'vbaproject\\.bin$|(?:^|/)embeddings/|(?:^|/)activex/|afchunk')) > 0 THEN 'UNSUPPORTED_OBJECT' WHEN count(*) > 3 THEN 'TOO_MANY_MEMBERS' ELSE 'TOO_MANY_BYTES' END AS code FROM (SELECT document, bytes, CASE WHEN row_id % 40 = 0 THEN 'word/embeddings/' || name ELSE name END AS name FROM inventory_item WHERE kind IN ('image', 'media') AND bytes IS NOT NULL AND name IS NOT NULL) GROUP BY document HAVING count(*) > 3 OR sum(bytes) > 200000 OR count(*) FILTER (regexp_matches(lower(name), 'vbaproject\\.bin$|(?:^|/)embeddings/|(?:^|/)activex/|afchunk')) > 0")
def package_limits(spark: SparkSession, folder: str) -> DataFrame:
    """Limits and unsupported members of packages."""
    from docweft.operators import templates

    rows = table(spark, folder, "inventory_item", "document", "row_id", "kind", "bytes", "name").where("kind IN ('image', 'media') AND bytes IS NOT NULL AND name IS NOT NULL")
    members = rows.select("document", F.when(F.col("row_id") % 40 == 0, F.concat(F.lit("word/embeddings/"), "name")).otherwise(F.col("name")).alias("member"), F.col("bytes").alias("size"))
    return templates.package_limits(members, "document", 3, 200_000)


@query("SELECT p_partkey, round(CASE p_size % 6 WHEN 0 THEN p_size WHEN 1 THEN p_size / 72.0 WHEN 2 THEN p_size / 2.54 WHEN 3 THEN p_size / 25.4 WHEN 4 THEN p_size / 96.0 ELSE p_size / 72.0 END, 4) AS inches FROM part WHERE p_size > 0")
def css_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """C17: lengths with units in inches."""
    rows = table(spark, folder, "part", "p_partkey", "p_size").where("p_size > 0")
    unit = F.element_at(F.array(*map(F.lit, ("in", "pt", "cm", "mm", "px", ""))), (F.col("p_size") % 6 + 1).cast("int"))
    return rows.select("p_partkey", F.round(grids.css_inches(F.concat(F.col("p_size").cast("string"), unit)), 4).alias("inches"))


@query(r"SELECT document, try_cast(nullif(regexp_extract(file_name, '([0-9]+)[^0-9]*$', 1), '') AS BIGINT) AS number FROM source_document")
def file_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers in file names, as numbers."""
    return table(spark, folder, "source_document", "document", "file_name").select("document", F.regexp_extract("file_name", r"([0-9]+)[^0-9]*$", 1).try_cast("bigint").alias("number"))


@query("SELECT row_id, contains(t, '二维码') OR contains(t, 'qr code') OR contains(t, 'qrcode') OR contains(t, 'qr-code') OR contains(t, 'qr_code') AS qr FROM (SELECT row_id, lower(concat_ws(' ', text, name, title, description, CASE WHEN row_id % 97 = 0 THEN 'QR-Code' END)) AS t FROM inventory_item)")
def qr_markers(spark: SparkSession, folder: str) -> DataFrame:
    """Items that speak of a QR code."""
    from docweft.functions import patterns

    rows = table(spark, folder, "inventory_item", "row_id", "text", "name", "title", "description")
    every = F.lower(F.concat_ws(" ", "text", "name", "title", "description", F.when(F.col("row_id") % 97 == 0, "QR-Code")))
    return rows.select("row_id", patterns.contains_any(every, patterns.QR_MARKERS).alias("qr"))
