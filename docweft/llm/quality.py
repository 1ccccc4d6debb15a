"""Problem 9: text statistics of each document, and the form they point to.

A document is split into chunks, at line ends where a chunk holds one. Each chunk gives partial counts that add up: it sees
a halo of its neighbours, so tokens across a cut count once. A line longer than a chunk leaves a boundary state in each
of its chunks; the states merge to the line's own. Partial counts are summed per document with map-side partial
aggregation, ratios and the form follow from the sums, and nothing depends on where the cuts fell.

The counting itself runs in Arrow batches: one translation of a chunk into character classes answers most questions by
counting letters, which took a quarter of the time of the same counts as patterns inside of the JVM.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = 20_000

#: Punctuation that prose, tables and lists use; other symbols are odd.
PLAIN = set("|-.,:/≤≥×°%()（）、。，：；;!?！？'\"“”…")
END, CLOSERS = set(".!?。！？…;；"), "”\"'’」』)）】]"
BULLET = re.compile(r"[ \t]*(?:[-*•·●○◦▪■□☐☑✓✔–—→>][ \t]*|\(?\d{1,3}[.)、][ \t]*|（[一二三四五六七八九十\d]{1,3}）[ \t]*|[一二三四五六七八九十]{1,3}、[ \t]*|[A-Za-z][.)][ \t]+)\S")
HAN = re.compile("[一-鿿]")
GAP = re.compile(r" {3}\S")
GAPS = re.compile(r"\S.*? {3,}\S")
CODE = re.compile(r"[A-Za-z0-9+/=]{40,}|(?<![A-Za-z0-9_])(?=[a-f]*[0-9])[0-9a-f]{8,}(?![A-Za-z0-9_])")
NAV = re.compile(r"(?:[^\W\d_]{1,64}(?: [^\W\d_]{1,64})? ?[>»›|/·] ?){3,}")
#: Three of its marks, each within a unit's length.
NAV_MARKS = re.compile("(?:[>»›|/·][^>»›|/·\n]{0,131}){2}[>»›|/·]")
LATIN = re.compile(r"[a-z]{3,64}")
TOKEN = re.compile(r"[^\W_]+")
RANDOM = re.compile(r"[bcdfghjklmnpqrstvwxz]{4}|[bcdfghjkmnpqtvwxz]{3}")
MOJIBAKE = re.compile("[mqb]{2,}")
WORDS = re.compile("[lmd]+")

#: What a chunk sees of its neighbours: more than any token that is counted, or than the stretch that tells it.
HALO = 400
PERIODS = 8
COUNTS = (
    "chars", "nonspace", "han", "words", "word_chars", "latin_words", "random_words", "symbols", "common", "lines", "ended_lines", "table_chars", "mojibake_chars", "symbol_chars", "code_chars", "nav_chars", "bullet_chars", "short_chars", "short_lines",
    *(f"repeat_{p}" for p in range(1, PERIODS + 1)),
)
LINE_COUNTS = ("lines", "ended_lines", "table_chars", "bullet_chars", "short_chars", "short_lines")
#: Marks between the values of a row, and what stands in no row of theirs.
ROW_MARKS = ((",", "[。！？；]"), (";", "[。！？；,]"))
#: The state of a part of a line; ``head``: it began in an earlier chunk, ``tail``: it goes on in the next.
CUT = dict(
    row=T.LongType, no=T.IntegerType, head=T.BooleanType, tail=T.BooleanType, size=T.LongType, filled=T.BooleanType, bare=T.LongType, han=T.BooleanType, end=T.BooleanType, bullet=T.BooleanType, solid=T.BooleanType, tab=T.BooleanType, gap=T.BooleanType,
    first_pipe=T.BooleanType, last_pipe=T.BooleanType, commas=T.LongType, bad_commas=T.BooleanType, semis=T.LongType, bad_semis=T.BooleanType,
)
ARROW = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.BooleanType: pa.bool_()}


class Classes(dict):
    """Character to class: h Han, l letter, m letter of broken encodings, d number, p plain and o odd symbol, q odd
    symbol of broken encodings, b a space that broken encodings leave, s other space, n newline."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        broken = 0x80 <= code <= 0xBF or code in (0xC2, 0xC3, 0xFFFD) or 0xE2 <= code <= 0xEF
        kind = unicodedata.category(char)
        if char == "\n":
            found = "n"
        elif char.isspace():
            found = "b" if broken else "s"
        elif kind[0] in "LM":
            found = "h" if unicodedata.name(char, "").startswith(("CJK UNIFIED", "CJK COMPAT", "KANGXI", "CJK RADICAL")) else "m" if broken else "l"
        elif kind[0] == "N":
            found = "d"
        else:
            found = "p" if char in PLAIN else "q" if broken else "o"
        self[code] = found
        return found


FIELD = (1 << 32) - 1


class Tokens(dict):
    """Lower-case token to what it adds to three counts, 32 bits each: frequent words, Latin words, random words."""

    def __init__(self, common: Iterator[str]) -> None:
        self.common = frozenset(common)

    def __missing__(self, token: str) -> int:
        latin = len(token) > 3 and LATIN.fullmatch(token) is not None
        adds = (token in self.common) | latin << 32 | (LATIN.fullmatch(token) is not None and RANDOM.search(token) is not None) << 64
        if len(self) >= 1 << 17:  # bounds what a worker keeps
            self.clear()
        self[token] = adds
        return adds


class Counter:
    """The partial counts of a chunk, given a list of frequent words.

    Every token that is counted has a bounded length or is told by a bounded stretch of it, so a chunk that sees
    ``HALO`` characters on both sides counts what starts, or lies, in its own part as it would in the whole text.
    """

    def __init__(self, common: list[str]) -> None:
        self.classes = Classes()
        self.tokens = Tokens(w.lower() for w in common if w.isascii())
        singles = "".join(w for w in common if not w.isascii() and len(w) == 1)
        self.single = re.compile(f"[{re.escape(singles)}]") if singles else None
        # a longer word counts with the characters that aren't frequent words by themselves
        self.longer = [(w, more) for w in common if not w.isascii() and len(w) > 1 and (more := sum(c not in singles for c in w))]

    def __call__(self, own: str, before: str = "", after: str = "") -> tuple[list[int], tuple | None]:
        """(counts, fragment): the counts, and the state of a line that is cut at the chunk's start or end."""
        text = before + own + after if before or after else own
        low, high = len(before), len(before) + len(own)
        kinds = own.translate(self.classes)
        n = {k: kinds.count(k) for k in "hlmdpoqbsn"}
        runs = len(WORDS.findall(kinds)) - bool(before and own and kinds[0] in "lmd" and before[-1].translate(self.classes) in "lmd")
        tokens = 0
        if n["l"]:
            small = text.lower()
            if low or high < len(text):
                if len(small) != len(text):
                    small = "".join(x if len(x := c.lower()) == 1 else c for c in text)
                tokens = sum(self.tokens[m[0]] for m in TOKEN.finditer(small) if low <= m.start() < high)
            else:
                tokens = sum(map(self.tokens.__getitem__, TOKEN.findall(small)))
        common, latin, random = tokens & FIELD, tokens >> 32 & FIELD, tokens >> 64
        if n["h"]:
            common += len(self.single.findall(own)) if self.single else 0
            common += sum(starts(own + after[: len(w) - 1], w) * more for w, more in self.longer)
        odd = n["o"] + n["q"]
        broken = code = nav = 0
        if n["m"] + n["q"] > 0:
            edge = before[-1:] + own + after[:1]
            broken = clipped(MOJIBAKE.finditer(edge.translate(self.classes)), len(before[-1:]), len(before[-1:]) + len(own))
        if low or high < len(text):
            code = clipped(CODE.finditer(text), low, high)
        else:
            code = sum(len(m) for token in own.split() if len(token) >= 8 for m in CODE.findall(token))
        if NAV_MARKS.search(text):
            nav = clipped(NAV.finditer(text), low, high)
        parts = own.split("\n")
        head, tail = bool(before) and before[-1] != "\n", bool(after) and own[-1:] != "\n"
        fragment = None
        if head or tail:  # a chunk ends at a line end where it holds one: a line that is cut is all of it, or its start
            first = parts.pop(0)
            fragment = self.fragment(first, head, tail and not parts, len(first) + bool(parts), before[-HALO:].rpartition("\n")[2], "" if parts else after.partition("\n")[0])
        lines = ended = table = bullet = short = short_lines = 0
        final = len(parts) - 1
        for i, line in enumerate(parts):
            bare = line.rstrip(" \t\r")
            if not bare or bare.isspace():
                continue
            lines += 1
            end = is_end(bare)
            ended += end
            size = len(line) + (i < final)
            if is_table(line, bare):
                table += size
            elif BULLET.match(line):
                bullet += size
                short_lines += 1
            elif not end and len(bare) <= 48 and (len(bare) <= 24 or not n["h"] or not HAN.search(bare)):
                short += size
                short_lines += 1
        return [
            len(own), len(own) - n["s"] - n["n"] - n["b"], n["h"], runs + n["h"], n["l"] + n["m"] + n["d"] + n["h"], latin, random, n["p"] + odd, common, lines, ended, table,
            broken, odd, code, nav, bullet, short, short_lines, *repeated(text, low, high),
        ], fragment

    def fragment(self, part: str, head: bool, tail: bool, size: int, before: str, after: str) -> tuple:
        """The state of a part of a line: all that the line's form hangs on. The states of neighbours merge."""
        seen, low, high = before + part + after, len(before), len(before) + len(part)
        bare = part.rstrip(" \t\r")
        filled = bool(bare) and not bare.isspace()
        gap = any(low <= m.end() - 1 < high for m in GAP.finditer(seen))
        state = [head, tail, size, filled, len(bare), bool(HAN.search(bare)), is_end(before[-64:] + bare) if filled else None, not head and bool(BULLET.match(part + after)), not head and bool(part[:1].strip()), "\t" in part, gap]
        state += [bare.lstrip(" \t")[0] == "|" if filled else None, bare[-1] == "|" if filled else None]
        for mark, never in ROW_MARKS:
            bad = bool(re.search(never, part)) or (not head and part[:1] == mark) or (not tail and part[-1:] == mark)
            bad = bad or any(low <= m.start() < high for m in re.finditer(f"{mark}(?=[{mark} ])", seen))
            bad = bad or any(m.end() > low and m.start() < high and (len(m[0]) > 40 or HAN.search(m[0])) for m in re.finditer(f"[^{mark}]{{13,}}", seen))
            state += [part.count(mark), bad]
        return tuple(state)


def starts(text: str, word: str) -> int:
    """How often ``word`` starts in ``text``, overlapping itself or not."""
    count, at = 0, text.find(word)
    while at >= 0:
        count, at = count + 1, text.find(word, at + 1)
    return count


def clipped(found: Iterator[re.Match], low: int, high: int) -> int:
    """The characters of matches that lie between two positions."""
    return sum(min(m.end(), high) - max(m.start(), low) for m in found if m.end() > low and m.start() < high)


def is_end(bare: str) -> bool:
    """Whether a line ends like a sentence, with at most 64 closing marks behind the stop."""
    return bare[-1] in END or (bare[-1] in CLOSERS and bare[-64:].rstrip(CLOSERS)[-1:] in END)


def is_table(line: str, bare: str) -> bool:
    return "\t" in line or (bare[-1] == "|" and bare.lstrip(" \t")[0] == "|" and len(bare) > 1) or ("   " in bare and bool(GAPS.match(bare))) or ("," in bare and is_row(line, *ROW_MARKS[0])) or (";" in bare and is_row(line, *ROW_MARKS[1]))


def is_row(line: str, mark: str, never: str) -> bool:
    """Whether a line is three or more values between marks: short, not behind a space, without a sentence's marks."""
    if line.count(mark) < 2:
        return False
    cells = line.split(mark)
    if not all(cells) or any(len(c) > 40 or c[0] == " " for c in cells[1:]) or len(cells[0]) > 40 or re.search(never, line):
        return False
    return all(len(c) <= 12 or not HAN.search(c) for c in cells)


def repeated(text: str, low: int, high: int) -> list[int]:
    """For each unit of up to eight characters, the characters of stretches that repeat it at least eight times."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    found = [0] * PERIODS
    for period in range(1, PERIODS + 1):
        if len(codes) <= 7 * period:
            break
        same = codes[period:] == codes[:-period]
        if b"\1" * (7 * period) in same.tobytes():
            edges = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
            begins, ends = edges[::2], edges[1::2]
            long = ends - begins >= 7 * period
            found[period - 1] = int(np.maximum(np.minimum(ends[long] + period, high) - np.maximum(begins[long], low), 0).sum())
    return found


def chunk_counts(df: DataFrame, common: list[str], key: str, text: str, chunk: int) -> DataFrame:
    """(_key, partial counts, _cut) of each chunk; a null text counts as empty. ``_cut`` is the state of a line that
    the chunk holds only a part of."""
    if chunk < 2 * HALO:
        raise ValueError(f"a chunk has at least {2 * HALO} characters")
    body = F.coalesce(F.col(text), F.lit(""))
    pieces = F.when(F.length(body) <= chunk, F.array(body)).otherwise(F.regexp_extract_all(body, F.lit(rf"(?s).{{1,{chunk}}}\z|.{{0,{chunk}}}\n|.{{1,{chunk}}}"), F.lit(0)))
    rows = df.select(F.col(key).alias("_key"), F.monotonically_increasing_id().alias("_row"), pieces.alias("_pieces"))

    def piece(i: Column) -> Column:
        return F.coalesce(F.get(F.col("_pieces"), i), F.lit(""))

    # two neighbours on either side together hold a halo, as a chunk that ends early is followed by one that doesn't
    seen = F.transform(
        F.col("_pieces"),
        lambda x, i: F.struct(
            x.alias("own"), F.when(i > 0, F.substring(F.concat(piece(i - 2), piece(i - 1)), -HALO, HALO)).otherwise("").alias("before"), F.when(i < F.size("_pieces") - 1, F.substring(F.concat(piece(i + 1), piece(i + 2)), 1, HALO)).otherwise("").alias("after")
        ),
    )
    rows = rows.select("_key", "_row", F.posexplode(seen).alias("_no", "_c")).select("_key", "_row", "_no", "_c.own", "_c.before", "_c.after")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(common)
        for batch in batches:
            counted, cuts = [], []
            for row, no, *texts in zip(*(batch.column(i).to_pylist() for i in range(1, 6)), strict=True):
                counts, fragment = count(*texts)
                counted.append(counts)
                cuts.append(None if fragment is None else dict(zip(CUT, (row, no, *fragment), strict=True)))
            columns = list(zip(*counted, strict=True)) or [[] for _ in COUNTS]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns), pa.array(cuts, pa.struct([(n, ARROW[t]) for n, t in CUT.items()]))], names=["_key", *COUNTS, "_cut"])

    cut = T.StructType([T.StructField(n, t()) for n, t in CUT.items()])
    schema = T.StructType([T.StructField("_key", df.schema[key].dataType), *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("_cut", cut)])
    return rows.mapInArrow(run, schema)


def cut_lines(cuts: str) -> Column:
    """The line counts of the lines that chunks cut, from their states in order."""

    def merged(a: Column, b: Column) -> Column:
        whole = {
            "size": a["size"] + b["size"], "filled": a["filled"] | b["filled"], "bare": F.when(b["filled"], a["size"] + b["bare"]).otherwise(a["bare"]), "end": F.coalesce(b["end"], a["end"]),
            "first_pipe": F.coalesce(a["first_pipe"], b["first_pipe"]), "last_pipe": F.coalesce(b["last_pipe"], a["last_pipe"]), "commas": a["commas"] + b["commas"], "semis": a["semis"] + b["semis"],
        }
        whole |= {n: a[n] | b[n] for n in ("han", "bullet", "solid", "tab", "gap", "bad_commas", "bad_semis")}
        return F.struct(*(whole.get(n, b[n]).alias(n) for n in CUT))

    def counted(total: Column, x: Column) -> Column:
        """What a line adds once its last part is there."""
        row = x["tab"] | (x["first_pipe"] & x["last_pipe"] & (x["bare"] > 1)) | (x["gap"] & x["solid"]) | ((x["commas"] >= 2) & ~x["bad_commas"]) | ((x["semis"] >= 2) & ~x["bad_semis"])
        forms = F.struct(row.alias("row"), (x["bullet"]).alias("bullet"), (~x["end"] & (x["bare"] <= 48) & ((x["bare"] <= 24) | ~x["han"])).alias("short"), (~x["tail"] & x["filled"]).alias("done"))
        return F.get(F.transform(F.array(forms), lambda f: added(total, x, f["row"], ~f["row"] & f["bullet"], ~f["row"] & ~f["bullet"] & f["short"], f["done"])), F.lit(0))

    def added(total: Column, x: Column, row: Column, bullet: Column, short: Column, done: Column) -> Column:
        adds = {"lines": F.lit(1), "ended_lines": x["end"], "table_chars": F.when(row, x["size"]), "bullet_chars": F.when(bullet, x["size"]), "short_chars": F.when(short, x["size"]), "short_lines": bullet | short}
        return F.struct(*(F.when(done, total[n] + F.coalesce(v.cast("bigint"), F.lit(0))).otherwise(total[n]).alias(n) for n, v in adds.items()))

    def step(acc: Column, x: Column) -> Column:
        line = F.array(F.when(x["head"], merged(acc["line"], x)).otherwise(x))
        # a lambda's variable stands for the line, so that its expression isn't repeated in every count
        return F.get(F.transform(line, lambda y: F.struct(y.alias("line"), counted(acc["total"], y).alias("total"))), F.lit(0))

    ordered = F.sort_array(cuts)
    nothing = F.struct(F.get(ordered, F.lit(0)).alias("line"), F.struct(*(F.lit(0).cast("bigint").alias(n) for n in LINE_COUNTS)).alias("total"))
    return F.when(F.size(cuts) > 0, F.aggregate(ordered, nothing, step)["total"])


def summed_counts(partial: DataFrame) -> DataFrame:
    """(_key, counts) of each document from those of its chunks."""
    sums = partial.groupBy("_key").agg(*(F.sum(c).alias(c) for c in COUNTS), F.collect_list("_cut").alias("_cuts"))
    # a generator of one row: the merged states are computed once, not in every expression and filter that uses them
    sums = sums.select("_key", *COUNTS, F.explode(F.array(cut_lines("_cuts"))).alias("_lines"))
    return sums.select("_key", *((F.col(c) + F.coalesce(F.col("_lines")[c], F.lit(0)) if c in LINE_COUNTS else F.col(c)).alias(c) for c in COUNTS))


def document_statistics(df: DataFrame, common: list[str], key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(key, counts, ratios, form) of each key, the same for any size of chunk.

    A Han character counts as a word, like every run of other letters and digits. Null, empty and blank texts have
    zero counts, ratios of 0 and no form (null). Rows that repeat a key are one document, their counts added up.
    Other columns are not read. ``common`` is a short list of frequent words. Of a document, at most one small state for
    each chunk is merged in order (a value of the engine has at most 2 GB, so at most a hundred thousand of them); all
    else is summed before the exchange.
    """
    sums = summed_counts(chunk_counts(df, common, key, text, chunk))
    sums = sums.withColumn("repeat_chars", F.greatest(*(c for c in COUNTS if c.startswith("repeat_"))))

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    c = F.col
    ratios = {
        "mean_word_length": F.round(share("word_chars", "words"), 4),
        "symbol_ratio": F.round(share("symbols", "nonspace"), 4),
        "ended_line_share": F.round(share("ended_lines", "lines"), 4),
        "common_word_share": F.round(share("common", "words"), 4),
    }
    junk = (
        (share("mojibake_chars", "nonspace") > 0.25)
        | (share("symbol_chars", "nonspace") > 0.25)
        | (share("code_chars", "nonspace") > 0.5)
        | (share("repeat_chars", "chars") > 0.5)
        | (share("nav_chars", "chars") > 0.5)
        | ((c("latin_words") >= 5) & (c("han") * 4 < c("nonspace")) & (share("random_words", "latin_words") > 0.35) & (share("common", "words") < 0.05))
    )
    table = (share("table_chars", "chars") > 0.5) & (c("lines") > 1) & (share("symbol_chars", "nonspace") <= 0.3)
    form = (
        F.when(c("nonspace") == 0, F.lit(None))
        .when(junk & ~(table & (share("table_chars", "chars") > 0.8)), "junk")
        .when(table, "table")
        .when(((c("bullet_chars") + c("short_chars")) / c("chars") > 0.5) & (c("short_lines") >= 3), "list")
        .otherwise("prose")
    )
    return sums.select(
        c("_key").alias(key), "chars", "words", "lines", *(v.alias(k) for k, v in ratios.items()),
        F.round(share("table_chars", "chars"), 4).alias("table_share"), F.round((c("bullet_chars") + c("short_chars")) / F.greatest("chars", F.lit(1)), 4).alias("entry_share"), form.alias("form"),
    )


def common_words(df: DataFrame, most: int = 1000) -> list[str]:
    """The words of a list of function words. It is read to the driver, so it must have at most ``most`` rows."""
    rows = df.where("word IS NOT NULL AND word <> ''").select("word").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a list of common words has at most {most} words")
    return sorted(r.word for r in rows)
