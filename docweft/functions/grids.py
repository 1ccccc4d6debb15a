"""Tables as arrays of rows of cells, and the sizes things are drawn at."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Headings and values of a column that only numbers its rows.
SERIAL_HEADS = ("序号", "序列号", "编号", "no")
SERIAL_VALUE = r"^(?:\d+|[一二三四五六七八九十百千零〇]+|[①②③④⑤⑥⑦⑧⑨⑩]+|[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]+)$"
SERIAL_NOISE = r"[\s\.．、,，:：;；\-_/\\()（）\[\]【】]+"


def text_rows(rows: Column) -> Column:
    """Rows without nulls: a null row is empty, a null cell an empty string."""
    return F.transform(F.coalesce(rows, F.array().cast("array<array<string>>")), lambda r: F.transform(F.coalesce(r, F.array().cast("array<string>")), lambda c: F.coalesce(c, F.lit(""))))


def joined_text(rows: Column) -> Column:
    """Cells joined by tabs, rows by newlines."""
    return F.array_join(F.transform(text_rows(rows), lambda r: F.array_join(r, "\t")), "\n")


def width(rows: Column) -> Column:
    """Cells of the longest row; 0 without rows."""
    return F.coalesce(F.array_max(F.transform(text_rows(rows), F.size)), F.lit(0))


def padded(rows: Column) -> Column:
    """Ragged rows filled up with empty cells."""
    return F.transform(text_rows(rows), lambda r: F.concat(r, F.array_repeat(F.lit(""), F.greatest(width(rows) - F.size(r), F.lit(0)))))


def preview(rows: Column, size: int = 20, chars: int = 500) -> Column:
    """The first rows and cells, cells cut."""
    return F.transform(F.slice(text_rows(rows), 1, size), lambda r: F.transform(F.slice(r, 1, size), lambda c: F.substring(c, 1, chars)))


def serial_token(cell: Column) -> Column:
    return F.lower(F.regexp_replace(cell, SERIAL_NOISE, ""))


def has_serial_column(rows: Column) -> Column:
    """Whether the first column only numbers the rows.

    At least two rows. If the column's first filled cell is a heading of serial numbers, all filled cells behind the
    first row must be numbers; else the other columns must hold something and every filled cell must be a number.
    """
    table = text_rows(rows)
    first = F.transform(table, lambda r: F.trim(F.coalesce(F.get(r, 0), F.lit(""))))
    filled = F.filter(first, lambda c: c != "")
    behind = F.filter(F.slice(first, 2, 1_000_000), lambda c: c != "")
    headed = serial_token(F.coalesce(F.get(filled, 0), F.lit(""))).isin(*SERIAL_HEADS)
    others = F.exists(table, lambda r: F.exists(F.slice(r, 2, 1_000_000), lambda c: F.trim(c) != ""))
    numbers = F.forall(filled, lambda c: serial_token(c).rlike(SERIAL_VALUE))
    return (F.size(table) >= 2) & (F.size(filled) > 0) & F.when(headed, (F.size(behind) > 0) & F.forall(behind, lambda c: serial_token(c).rlike(SERIAL_VALUE))).otherwise(others & numbers)


def without_serial_column(rows: Column) -> Column:
    return F.when(has_serial_column(rows), F.transform(text_rows(rows), lambda r: F.slice(r, 2, 1_000_000))).otherwise(text_rows(rows))


def css_inches(length: Column, ppi: float = 96.0) -> Column:
    """A CSS length in inches (in, pt, cm, mm, px; points without a unit); null if it is none or not positive."""
    number = F.expr("1") * F.regexp_extract(F.lower(F.trim(length)), r"^([0-9]+(?:\.[0-9]+)?)\s*(in|pt|cm|mm|px)?$", 1).try_cast("double")
    unit = F.regexp_extract(F.lower(F.trim(length)), r"^([0-9]+(?:\.[0-9]+)?)\s*(in|pt|cm|mm|px)?$", 2)
    inches = F.when(unit == "in", number).when(unit == "cm", number / 2.54).when(unit == "mm", number / 25.4).when(unit == "px", number / ppi).otherwise(number / 72.0)
    return F.when(inches > 0, inches)


def fitted(width_in: Column, height_in: Column, max_width: float, max_height: float) -> Column:
    """(width, height) scaled down, never up, to fit a box."""
    scale = F.least(F.lit(1.0), F.lit(max_width) / width_in, F.lit(max_height) / height_in)
    return F.struct((width_in * scale).alias("width"), (height_in * scale).alias("height"))


def trailing_span(row: Column) -> Column:
    """How many cells the last filled cell of a row spans with the empty ones behind it; an empty row is one cell. Null where
    no cell behind the last filled one is empty."""
    filled = F.coalesce(F.array_max(F.filter(F.transform(row, lambda c, i: F.when(F.coalesce(F.trim(c), F.lit("")) != "", i + 1)), lambda i: i.isNotNull())), F.lit(0))
    width = F.size(row)
    return F.when((width > 0) & (filled < width), F.when(filled == 0, width).otherwise(width - filled + 1))
