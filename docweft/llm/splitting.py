"""Problem 1: pieces of oversized contents, cut at natural boundaries by byte ranges.

A content is a stretch of bytes of a file in shared storage: a whole file, or a value of a column that was written
there. Workers read it by ranges. They count the code points of each range; the prefix sums of these counts tell where
in the content a range stands. Each range, with a halo of its neighbours, then looks for the best boundary in every
window that ends in it. The boundary tables of all ranges are stitched to the table of pieces, which holds numbers only,
and every piece is read by its offset. No task holds a content, and the cuts don't depend on the size of the ranges.

With ``limit`` 4 000 and ``overlap`` 200, windows end every ``span`` = 3 000 code points and are ``window`` = 800 long:
a piece has at most span + window + overlap = limit code points.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweft.session import cut_lineage, shared_folder

LIMIT, OVERLAP, WINDOW = 4000, 200, 800
#: Bytes of a content that a worker reads at once.
RANGE = 1 << 20
#: Ranges whose counts are summed up together, before the sums of such blocks are.
BLOCK = 1024

#: Kinds of boundaries from the strongest; each pattern ends where a cut may fall, at the last place in the window.
BOUNDARIES = tuple(
    (kind, re.compile(rf"(?s).*(?:{pattern})"))
    for kind, pattern in (
        ("paragraph", r"\n[ \t\r]*\n\s*"),
        ("line", r"\n"),
        ("sentence", r"[。！？!?；;][”’」』\"')）]*\s*|\.[”\"')]*\s+"),
        ("clause", r"[，、：,:\t][ ]*"),
        ("word", r"\s+"),
    )
)


def payload_content(payload: str = "payload") -> Column:
    """The sized content of a payload: text and description their text, generic its JSON, table all cells joined.

    Cells are joined by a tab, rows by a newline; a null cell or row counts as empty. Other types and null are null.
    """
    p = F.col(payload)
    cells = F.array_join(F.transform(p["rows"], lambda row: F.coalesce(F.array_join(row, "\t", ""), F.lit(""))), "\n", "")
    return F.when(p["type"].isin("text", "description"), p["text"]).when(p["type"] == "generic", p["value_json"]).when(p["type"] == "table", cells)


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system a URI names (a local path too), and the path in it."""
    return fs.FileSystem.from_uri(uri)


class Reader:
    """Stretches of files; neighbouring ones come from one read."""

    def __init__(self) -> None:
        self.path, self.file, self.at, self.data = "", None, 0, b""

    def __call__(self, path: str, low: int, high: int) -> bytes:
        if path != self.path:
            system, inner = file_system(path)
            self.path, self.file, self.data = path, system.open_input_file(inner), b""
        if not self.at <= low <= high <= self.at + len(self.data):
            self.at, self.data = low, self.file.read_at(max(high - low, RANGE), low)
        return self.data[low - self.at : high - self.at]


def _map(df: DataFrame, each, schema: str) -> DataFrame:
    """``each(read, row)`` gives tuples of ``schema``; rows are read in the order of their files."""
    parsed = df.sparkSession.createDataFrame([], schema).schema
    types = [{"string": pa.string(), "bigint": pa.int64()}[f.dataType.simpleString()] for f in parsed]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader()
        for batch in batches:
            out, size = [], 0
            for row in batch.to_pylist():
                for found in each(read, row):
                    out.append(found)
                    size += len(found[-1]) if isinstance(found[-1], str) else 8
                if size > 16 * RANGE:  # bounds what is held
                    yield _batch(out, parsed.names, types)
                    out, size = [], 0
            yield _batch(out, parsed.names, types)

    return df.mapInArrow(run, parsed)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def last_cut(window: str, ahead: str) -> tuple[int, str]:
    """(code points of the window before the best cut, its kind); ``ahead`` is what follows the window."""
    for kind, pattern in BOUNDARIES:
        if m := pattern.match(window):
            return m.end(), kind
    # without any boundary: at the window's end, unless a combining mark follows; then before the marked character
    at = len(window)
    if ahead and _joins(ahead[0]):
        at -= 1
        while at > 0 and _joins(window[at]):
            at -= 1
    return at, "none"


def _joins(char: str) -> bool:
    return char == "‍" or unicodedata.category(char)[0] == "M"


CONTENT = "path string, at bigint, size bigint"


def piece_table(contents: DataFrame, limit: int, overlap: int, window: int, range_bytes: int) -> DataFrame:
    """(path, at, piece_no, pieces, start, length, low, high, boundary) of ``contents`` (path, at, size), written once.

    ``start`` and ``length`` count code points, ``low`` and ``high`` bytes of the file. A code point is a byte that
    isn't a UTF-8 continuation.
    """
    span = limit - overlap - window
    if span < window or min(overlap, window) < 1 or range_bytes < 1:
        raise ValueError("limit must be at least overlap + 2 * window")
    halo = 4 * (window + overlap)
    one = ["path", "at"]

    def counted(read: Reader, row: dict) -> Iterator[tuple]:
        low = row["n"] * range_bytes
        data = read(row["path"], row["at"] + low, row["at"] + min(row["size"], low + range_bytes))
        yield row["path"], row["at"], row["size"], row["n"], int(np.count_nonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80))

    ranges = contents.where("size > 0").select(*one, "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(size - 1) DIV {range_bytes}"))).alias("n"))
    ranges = cut_lineage(_map(ranges, counted, CONTENT + ", n bigint, points bigint").withColumn("block", F.expr(f"n DIV {BLOCK}")))
    # prefix sums in two steps, so that no file's ranges are summed in one task
    before = (Window.unboundedPreceding, -1)
    blocks = ranges.groupBy(*one, "block").agg(F.sum("points").alias("of_block"))
    blocks = blocks.withColumn("first_block", F.coalesce(F.sum("of_block").over(Window.partitionBy(*one).orderBy("block").rowsBetween(*before)), F.lit(0)))
    totals = ranges.groupBy(*one).agg(F.sum("points").alias("total"), F.max("size").alias("size"))
    inside = F.coalesce(F.sum("points").over(Window.partitionBy(*one, "block").orderBy("n").rowsBetween(*before)), F.lit(0))
    placed = ranges.withColumn("inside", inside).join(blocks, [*one, "block"]).join(totals.drop("size"), one)
    placed = placed.where(f"total > {limit}").select(*one, "size", "n", "points", "total", (F.col("first_block") + F.col("inside")).alias("first"))

    def noted(read: Reader, row: dict) -> Iterator[tuple]:
        first, points = row["first"], row["points"]
        ends = range(first // span + 1, min((first + points) // span, (row["total"] - 1) // span) + 1)
        if not ends:
            return
        low = row["n"] * range_bytes
        back = min(low, halo)
        data = np.frombuffer(read(row["path"], row["at"] + low - back, row["at"] + min(row["size"], low + range_bytes + 8)), np.uint8)
        leads = np.flatnonzero(data & 0xC0 != 0x80)  # where code points begin
        zero = first - int(np.searchsorted(leads, back))  # the number of the first of them
        leads = np.append(leads, len(data))

        def stretch(a: int, b: int) -> str:
            return data[leads[a - zero] : leads[b - zero]].tobytes().decode("utf-8", "replace")

        for k in ends:
            end = k * span
            cut, kind = last_cut(stretch(end - window, end), stretch(end, min(end + 1, row["total"])))
            cut += end - window
            base = row["at"] + low - back
            yield row["path"], row["at"], k, cut, base + int(leads[cut - zero]), base + int(leads[cut - overlap - zero]), kind

    cuts = cut_lineage(_map(placed, noted, "path string, at bigint, k bigint, point bigint, byte bigint, lead bigint, kind string"))
    # stitched: a cut ends one piece and, with the overlap, begins the next
    nothing = F.lit(None).cast("bigint")
    closing = cuts.select(*one, (F.col("k") - 1).alias("piece_no"), nothing.alias("start"), nothing.alias("low"), F.col("point").alias("stop"), F.col("byte").alias("high"), F.col("kind").alias("boundary"))
    opening = cuts.select(*one, F.col("k").alias("piece_no"), (F.col("point") - overlap).alias("start"), F.col("lead").alias("low"), nothing.alias("stop"), nothing.alias("high"), F.lit(None).cast("string").alias("boundary"))
    pieces = F.when(F.col("total") > limit, F.expr(f"(total - 1) DIV {span} + 1")).otherwise(F.lit(1)).cast("bigint")
    counts = totals.select(*one, "total", "size", pieces.alias("pieces"))
    first = counts.select(*one, F.lit(0).cast("bigint").alias("piece_no"), F.lit(0).cast("bigint").alias("start"), F.col("at").alias("low"), nothing.alias("stop"), nothing.alias("high"), F.lit(None).cast("string").alias("boundary"))
    final = counts.select(*one, (F.col("pieces") - 1).alias("piece_no"), nothing.alias("start"), nothing.alias("low"), F.col("total").alias("stop"), (F.col("at") + F.col("size")).alias("high"), F.lit("end").alias("boundary"))
    ends = closing.unionByName(opening).unionByName(first).unionByName(final)
    table = ends.groupBy(*one, "piece_no").agg(*(F.max(c).alias(c) for c in ("start", "low", "stop", "high", "boundary"))).join(counts.select(*one, "pieces"), one)
    return cut_lineage(table.select(*one, "piece_no", "pieces", "start", (F.col("stop") - F.col("start")).alias("length"), "low", "high", "boundary"))


def read_pieces(table: DataFrame) -> DataFrame:
    """(path, at, piece_no, piece): the text of every piece, by a ranged read."""

    def emitted(read: Reader, row: dict) -> Iterator[tuple]:
        yield row["path"], row["at"], row["piece_no"], read(row["path"], row["low"], row["high"]).decode("utf-8", "replace")

    near = table.select("path", "at", "piece_no", "low", "high").withColumn("_part", F.expr(f"low DIV {16 * RANGE}"))
    near = near.repartition("path", "_part").sortWithinPartitions("path", "low").drop("_part")
    return _map(near, emitted, "path string, at bigint, piece_no bigint, piece string")


def stored(rows: DataFrame, keys: list[str], content: str) -> DataFrame:
    """(*keys, path, at, size) of the values of a column, whose bytes each task writes to a file in the shared folder."""
    folder = f"{shared_folder(rows.sparkSession)}/contents-{uuid.uuid4().hex}"
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("path", T.StringType()), T.StructField("at", T.LongType()), T.StructField("size", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, at, file = f"{folder}/{uuid.uuid4().hex}", 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if file is None:
                system, inner = file_system(path)
                system.create_dir(inner.rpartition("/")[0], recursive=True)
                file = system.open_output_stream(inner)
            offsets, sizes = [], []
            for value in batch.column(len(keys)):
                data = value.as_buffer()
                file.write(data)
                offsets.append(at)
                sizes.append(data.size)
                at += data.size
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array([path] * len(sizes), pa.string()), pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64())], names=[*keys, "path", "at", "size"])
        if file is not None:
            file.close()

    return cut_lineage(rows.select(*keys, content).mapInArrow(run, schema))


def _contents(df: DataFrame, keys: list[str], content: Column) -> DataFrame:
    return df.select(*(F.col(k).alias(f"_key_{k}") for k in keys), content.alias("_content")).where(F.col("_content").isNotNull())


def split_contents(df: DataFrame, keys: list[str], content: Column, limit: int = LIMIT, overlap: int = OVERLAP, window: int = WINDOW, range_bytes: int = RANGE) -> DataFrame:
    """(*keys, piece_no, start, length, pieces, boundary, piece) of every row with a content.

    ``start`` counts code points from 0, ``boundary`` names the kind of cut at the piece's end ("end" for the last).
    A content of at most ``limit`` comes out as one piece, an empty one as one empty piece; null contents give no
    row. Repeated rows give repeated pieces. Pieces past the first begin with the ``overlap`` code points before
    their cut; joined without these they give the content again. What has no more bytes than ``limit`` needs no
    ranges.
    """
    rows = _contents(df, keys, content)
    small = rows.where(F.octet_length("_content") <= limit)
    named = [f"_key_{k}" for k in keys]
    whole = small.select(*(F.col(n).alias(k) for n, k in zip(named, keys, strict=True)), F.lit(0).alias("piece_no"), F.lit(0).cast("bigint").alias("start"), F.length("_content").alias("length"), F.lit(1).alias("pieces"), F.lit("end").alias("boundary"), F.col("_content").alias("piece"))
    large = stored(rows.where(F.octet_length("_content") > limit), named, "_content")
    table = piece_table(large.select("path", "at", "size"), limit, overlap, window, range_bytes)
    cut = large.select(*named, "path", "at").join(table.drop("low", "high"), ["path", "at"]).join(read_pieces(table), ["path", "at", "piece_no"])
    numbers = {"piece_no": "int", "start": "bigint", "length": "int", "pieces": "int"}
    return whole.unionByName(cut.select(*(F.col(n).alias(k) for n, k in zip(named, keys, strict=True)), *(F.col(c).cast(t) for c, t in numbers.items()), "boundary", "piece"))


def oversized(df: DataFrame, keys: list[str], content: Column, limit: int = LIMIT, overlap: int = OVERLAP, window: int = WINDOW, range_bytes: int = RANGE) -> DataFrame:
    """Keys of the rows whose content comes out in more than one piece: those that have a second one in the table."""
    large = stored(_contents(df, keys, content).where(F.octet_length("_content") > limit), [f"_key_{k}" for k in keys], "_content")
    table = piece_table(large.select("path", "at", "size"), limit, overlap, window, range_bytes)
    second = table.where("piece_no = 1").select(F.col("path").alias("_path"), F.col("at").alias("_at"))
    return large.join(second, (F.col("path") == F.col("_path")) & (F.col("at") == F.col("_at")), "left_semi").select(*(F.col(f"_key_{k}").alias(k) for k in keys))


def split_files(spark: SparkSession, paths: list[str], limit: int = LIMIT, overlap: int = OVERLAP, window: int = WINDOW, range_bytes: int = RANGE) -> DataFrame:
    """(path, piece_no, start, length, pieces, boundary, piece) of UTF-8 files that are too large to load.

    The files, named by URI or path, must lie where every executor sees them. An empty file gives no piece. Bytes that
    are no UTF-8 are read as replacement characters; ``start`` and ``length`` count what begins a code point.
    """

    def sized(read: Reader, row: dict) -> Iterator[tuple]:
        system, inner = file_system(row["path"])
        yield row["path"], 0, system.get_file_info(inner).size

    files = cut_lineage(_map(spark.createDataFrame([(p,) for p in sorted(set(paths))], "path string"), sized, CONTENT))
    table = piece_table(files, limit, overlap, window, range_bytes)
    texts = table.drop("low", "high").join(read_pieces(table), ["path", "at", "piece_no"])
    return texts.select("path", F.col("piece_no").cast("int"), "start", F.col("length").cast("int"), F.col("pieces").cast("int"), "boundary", "piece")
