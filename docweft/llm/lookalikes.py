"""Problem 6: one form for texts that look alike.

A text's look-alike form maps each character to the one it looks like; texts of a document with equal forms under
Spark's ``UNICODE`` collation (accents and case differ, composed and combining accents are equal, invisible
characters are ignored) make one class. The class's canonical member is joined back to its rows.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.session import cut_lineage

# Letters of other scripts that look like a Latin letter (from Unicode's table of confusables).
CYRILLIC = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ё": "ë", "ї": "ï", "Ё": "Ë", "Ї": "Ï",
}
GREEK = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "ι": "i", "ρ": "p", "α": "a", "γ": "y", "υ": "u", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "κ": "k", "χ": "x",
}
ARMENIAN = {"ո": "n", "օ": "o", "ս": "u", "հ": "h", "ց": "g", "Տ": "S", "Ս": "U", "Օ": "O"}
# Radicals without a compatibility mapping that look like a character.
RADICALS = {
    "⺠": "民", "⻄": "西", "⻅": "见", "⻆": "角", "⻉": "贝", "⻋": "车", "⻓": "长", "⻔": "门", "⻘": "青", "⻙": "韦", "⻚": "页", "⻛": "风", "⻜": "飞", "⻝": "食", "⻢": "马", "⻣": "骨", "⻤": "鬼", "⻥": "鱼", "⻦": "鸟", "⻧": "卤",
    "⻨": "麦", "⻩": "黄", "⻬": "齐", "⻮": "齿", "⻰": "龙", "⻳": "龟", "⺟": "母", "⺫": "目", "⺮": "竹", "⺼": "肉", "⻁": "虎", "⻊": "足", "⻌": "辶", "⻏": "阝",
}
SPACES = "               　"
INVISIBLE = "­͏؜᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿︎️"
HYPHENS = "‐‑"
#: Blocks whose compatibility mapping keeps the look: fullwidth and halfwidth forms, ligatures, square units,
#: letterlike signs, and radicals. Raised and lowered digits, fractions and circled numbers aren't in them.
BLOCKS = ((0x2100, 0x214F), (0x2E80, 0x2FDF), (0x3300, 0x33FF), (0xFB00, 0xFB06), (0xFF01, 0xFFEE))
KEEP = "№℠℡™℻"  # №, raised letters and small capitals don't look like their letters


def mapping() -> dict[str, str]:
    """Character to the text it looks like."""
    out = {**CYRILLIC, **GREEK, **ARMENIAN, **RADICALS} | dict.fromkeys(SPACES, " ") | dict.fromkeys(HYPHENS, "-") | {"µ": "μ", "Ω": "Ω", "ı": "i"}
    for low, high in BLOCKS:
        for code in range(low, high + 1):
            char = chr(code)
            form = unicodedata.normalize("NFKC", char)
            if form != char and char not in KEEP and char not in out:
                out[char] = out.get(form, form)
    return out


#: Finds the few texts with a character that maps to several; ranges, as a class of many single characters is slow.
SEVERAL = r"[\x{2100}-\x{214f}\x{3300}-\x{33ff}\x{fb00}-\x{fb06}\x{ff61}-\x{ffee}]"


def lookalike_form(text: Column) -> Column:
    """``text`` with every look-alike mapped and invisible characters dropped; accents stay as they are."""
    table = mapping()
    single = {a: b for a, b in table.items() if len(b) == 1}
    several = {a: b for a, b in table.items() if len(b) > 1}
    spelled = F.create_map(*(F.lit(x) for pair in several.items() for x in pair))
    text = F.when(text.rlike(SEVERAL), F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(spelled[c], c)), "")).otherwise(text)
    source = "".join(single) + INVISIBLE  # characters past the target's end are dropped
    return F.when(text.rlike(r"[^\x00-\x7f]"), F.translate(text, source, "".join(single.values()))).otherwise(text)


def classes(df: DataFrame, key: str = "row_id", group: str = "document", text: str = "text") -> DataFrame:
    """(key, group, text, canonical) of the rows whose class holds more than one different text.

    Null and blank texts and rows without a group are in no class. The canonical member is a text that equals its own
    look-alike form where there is one, then the first in code-point order: the same for any order of rows.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(group).alias("_group"), F.col(text).alias("_text")).where(F.col("_group").isNotNull() & F.col("_text").rlike(r"[^\s\x{a0}\x{3000}]"))
    rows = rows.withColumn("_plain", lookalike_form(F.col("_text")))
    # the exchanges carry forms and numbers only; the few rows of classes with several texts are written once
    members = df.sparkSession.sql("""
        WITH keyed AS (SELECT _key, _group, _text, _plain COLLATE UNICODE AS _form FROM {rows}),
        several AS (SELECT _group, _form FROM keyed GROUP BY _group, _form HAVING min(xxhash64(_text)) <> max(xxhash64(_text)))
        SELECT k._key, k._group, k._text, k._form FROM keyed k LEFT SEMI JOIN several s ON k._group = s._group AND k._form = s._form
    """, rows=rows)
    found = df.sparkSession.sql("""
        WITH chosen AS (
            SELECT _group, _form, min(struct(CAST(_form AS STRING COLLATE UTF8_BINARY) <> _text AS odd, _text AS text)).text AS canonical
            FROM {members} GROUP BY _group, _form
        )
        SELECT m._key, m._group, m._text, c.canonical FROM {members} m JOIN chosen c ON m._group = c._group AND m._form = c._form
    """, members=cut_lineage(members))
    return found.select(F.col("_key").alias(key), F.col("_group").alias(group), F.col("_text").alias(text), "canonical")


def lookalike_pairs(df: DataFrame, key: str = "row_id", group: str = "document", text: str = "text") -> DataFrame:
    """(key_a, key_b) of every two rows of a group whose different texts look the same; the smaller key first."""
    rows = classes(df, key, group, text).select(F.col(key).alias("_k"), F.col(group).alias("_g"), F.col(text).alias("_t"), F.col("canonical").alias("_c"))
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a._g") == F.col("b._g")) & (F.col("a._c") == F.col("b._c")) & (F.col("a._k") < F.col("b._k")) & (F.col("a._t") != F.col("b._t")))
    return pairs.select(F.col("a._k").alias(f"{key}_a"), F.col("b._k").alias(f"{key}_b"))


def canonical_texts(df: DataFrame, key: str = "row_id", group: str = "document", text: str = "text") -> DataFrame:
    """(key, canonical) of every row: its class's canonical text, or its own text where nothing else looks like it."""
    found = classes(df, key, group, text).select(F.col(key).alias("_k"), "canonical").dropDuplicates(["_k"])
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(found, F.col("_key") == F.col("_k"), "left")
    return rows.select(F.col("_key").alias(key), F.coalesce("canonical", "_text").alias("canonical"))
