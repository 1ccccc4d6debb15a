"""Greedy sequential packing of items into task bundles.

The rule is sequential: a new batch starts where the next item would exceed a budget. Still no document is packed in
one task. Rows are sorted over range partitions; from any position, the start of the next batch lies at most
``max_items`` further on, so a partition needs a halo of that many sizes, and can be entered at that many positions
only. Each partition tells for every entry where it is left and how many batches start in it; composing these few
numbers over the partitions gives each one's entry, and a last narrow pass numbers the batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweft.session import cut_lineage

MAX_ITEMS, MAX_CHARS = 40, 16_000


def batch_starts(sizes: list[int], max_items: int, max_chars: int) -> list[int]:
    """For each position, where the batch after one that starts there begins; past the end if it isn't full by then."""
    out, end, chars = [], 0, 0
    for start, size in enumerate(sizes):
        if end <= start:
            end, chars = start + 1, size
        while end < len(sizes) and end - start < max_items and chars + sizes[end] <= max_chars:
            chars += sizes[end]
            end += 1
        out.append(end)
        chars -= size
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, object, list[int]]]:
    """(partition, key, sizes) of each run of equal keys in a sorted partition with columns key, size, partition."""
    key, sizes, part = None, None, 0
    for batch in batches:
        for k, n, p in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if sizes is None or k != key:
                if sizes is not None:
                    yield part, key, sizes
                key, sizes, part = k, [], p
            sizes.append(n)
    if sizes is not None:
        yield part, key, sizes


def _entries(rows: DataFrame, by: str, max_items: int, max_chars: int) -> dict[int, tuple[int, int]]:
    """Partition to (position of the first batch that starts in its first run, batches of that document before it).

    What reaches the driver is bounded by the number of partitions times ``max_items``.
    """
    slim = rows.select(by, "_size", "_part")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for run in _runs(batches):
            first, last, single = (run, run, True) if first is None else (first, run, False)
        if first is not None:
            yield pa.RecordBatch.from_pylist([{"part": first[0], "first": str(first[1]), "last": str(last[1]), "single": single, "head": first[2][:max_items]}], schema=head_schema)

    head_schema = pa.schema([("part", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("single", pa.bool_()), ("head", pa.list_(pa.int64()))])
    parts = sorted(slim.mapInArrow(heads, "part int, first string, last string, single boolean, head array<bigint>").collect(), key=lambda r: r.part)
    halos: dict[int, list[int]] = {}
    for i, row in enumerate(parts):
        halo: list[int] = []
        for later in parts[i + 1 :]:
            if later.first != row.last or len(halo) >= max_items:
                break
            halo += later.head
            if not later.single:
                break
        halos[row.part] = halo[:max_items]

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for last in _runs(batches):  # noqa: B007 - only the last run goes on into the next partition
            pass
        if last is None:
            return
        part, _, sizes = last
        following = batch_starts(sizes + halos[part], max_items, max_chars)
        left, started = [], []
        for entry in range(max_items + 1):
            at, n = entry, 0
            while at < len(sizes):
                at, n = following[at], n + 1
            left.append(at - len(sizes))
            started.append(n)
        yield pa.RecordBatch.from_pylist([{"part": part, "left": left, "started": started}], schema=passage_schema)

    passage_schema = pa.schema([("part", pa.int32()), ("left", pa.list_(pa.int32())), ("started", pa.list_(pa.int64()))])
    passed = {r.part: r for r in slim.mapInArrow(passages, "part int, left array<int>, started array<bigint>").collect()}
    out, before = {}, None
    entry, base = 0, 0
    for row in parts:
        if before is None or before.last != row.first:
            entry, base = 0, 0
        out[row.part] = (entry, base)
        if not row.single:
            entry, base = 0, 0
        step = passed[row.part]
        entry, base = step.left[entry], base + step.started[entry]
        before = row
    return out


def pack(items: DataFrame, by: str, order: list[str], size: str, max_items: int = MAX_ITEMS, max_chars: int = MAX_CHARS) -> DataFrame:
    """(by, *order, size, batch_index, oversize): items in order, a new batch where the next would exceed a budget.

    An item larger than the budget stands alone and is marked. A null size counts as 0, batches count from 0 in each
    ``by``, ties of ``order`` are packed in any order, an empty table gives an empty one.
    """
    rows = items.select(by, *order, F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("_size")).repartitionByRange(by, *order).sortWithinPartitions(by, *order)
    rows = cut_lineage(rows.withColumn("_part", F.spark_partition_id()))  # written: a range partitioning isn't repeatable
    entries = _entries(rows, by, max_items, max_chars)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: object = None
        begun, position, entry, index, count, chars = False, 0, 0, 0, 0, 0
        for batch in batches:
            out = []
            for k, n, part in zip(batch.column(at_by).to_pylist(), batch.column(at_size).to_pylist(), batch.column(at_part).to_pylist(), strict=True):
                if not begun or k != key:
                    entry, base = entries[part] if not begun else (0, 0)
                    begun, key, position, index, count, chars = True, k, 0, base - 1, max_items, 0
                if position < entry:
                    out.append(index)
                else:
                    if position == entry or count >= max_items or chars + n > max_chars:
                        index, count, chars = index + 1, 0, 0
                    out.append(index)
                    count, chars = count + 1, chars + n
                position += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], names=[*batch.schema.names, "batch_index"])

    names = rows.columns
    at_by, at_size, at_part = names.index(by), names.index("_size"), names.index("_part")
    schema = T.StructType([*rows.schema.fields, T.StructField("batch_index", T.IntegerType())])
    return rows.mapInArrow(number, schema).select(by, *order, F.col("_size").alias(size), "batch_index", (F.col("_size") > max_chars).alias("oversize"))


def batch_report(packed: DataFrame, by: str, size: str) -> DataFrame:
    """(by, batch_index, items, chars) of each batch."""
    return packed.groupBy(by, "batch_index").agg(F.count("*").alias("items"), F.sum(size).alias("chars"))
