"""Problem 5: personal information in free text and table cells, found and replaced by typed placeholders.

A transducer rewrites a text: full-width and look-alike characters become plain, invisible ones vanish, "(at)" and
"[dot]" become the signs, digits that are spelled out become digits. With each character it notes the source span it
came from. Detectors run on the rewritten text; what they find is mapped back, so values are the source's own
characters and all else stays as it is.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweft.llm import lookalikes
from docweft.llm.names import FAMILY, FAMILY_TWO, GIVEN, TITLES_EN, TITLES_ZH

DIGIT_WORDS = {w: str(i % 10) for i, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0"}
HAN_DIGITS = dict(zip("零〇一二三四五六七八九", "00123456789", strict=True))
_WORD = "|".join(DIGIT_WORDS)
AT = r"[ \t]{0,3}[(\[{<（【][ \t]{0,3}(?:at|AT|At|@)[ \t]{0,3}[)\]}>）】][ \t]{0,3}"
DOT = r"[ \t]{0,3}[(\[{<（【][ \t]{0,3}(?:dot|DOT|Dot|\.)[ \t]{0,3}[)\]}>）】][ \t]{0,3}"
SPELLED = rf"(?i:\b(?:{_WORD})(?:[ \t-]+(?:{_WORD})){{5,}}\b)|[零〇一二三四五六七八九]{{7,}}"
PLAIN_AT = r"(?<=[A-Za-z0-9])[ \t]{1,3}at[ \t]{1,3}(?=[A-Za-z0-9-]{1,63}[ \t]{1,3}dot[ \t]{1,3}[A-Za-z0-9-])"
PLAIN_DOT = r"(?<=[A-Za-z0-9])[ \t]{1,3}dot[ \t]{1,3}(?=[A-Za-z0-9])"
DISGUISE = re.compile(f"(?P<at>{AT})|(?P<dot>{DOT})|(?P<spelled>{SPELLED})|(?P<pat>{PLAIN_AT})|(?P<pdot>{PLAIN_DOT})|(?P<char>[^\\x00-\\x7f\\u4e00-\\u9fff，。、；“”‘’！？])")
CHARS = {c: form for c, form in lookalikes.mapping().items() if c not in "，。、；：（）！？"} | dict.fromkeys(lookalikes.INVISIBLE, "")

EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-])")
_EXT = r"(?:[ ]?(?:ext\.?|x|转|分机|#)[ ]?\d{1,6})?"
PHONE = re.compile(
    r"(?<![\w.+-])(?<!\d[ ])(?:"
    r"\+86[ -]?1[3-9]\d(?:[ -]?\d{4}){2}|1[3-9]\d(?:[ -]?\d{4}){2}"  # Chinese mobile
    r"|(?:\+86[ -]?)?(?:\(0\d{2,3}\)[ -]?|0\d{2,3}[ -])[2-9]\d{6,7}(?:-\d{1,5})?"  # Chinese landline
    r"|\+86[ -]?\d{2,3}[ -][2-9]\d{6,7}(?:-\d{1,5})?|[48]00[ -]\d{3}[ -]\d{4}|[48]00[ -]\d{4}[ -]\d{3}"
    r"|(?:\+?1[ .-])?(?:\([2-9]\d{2}\)[ ]?|[2-9]\d{2}[ .-])\d{3}[ .-]\d{4}"  # North America
    r"|\+44[ ]?\(?0?\)?[ ]?\d{2,5}[ ]\d{3,4}[ ]?\d{3,6}|\+44[ ]?\d{4}[ ]\d{6}|0\d{2}[ ]\d{4}[ ]\d{4}|0\d{3}[ ]\d{3}[ ]\d{4}|0\d{4}[ ]\d{5,6}"  # United Kingdom
    r"|\+(?!86|1[ .-]|44)(?=(?:[ .()-]{0,3}\d){7})\d{1,3}(?:[ .-]?\(?\d{1,5}\)?){2,5}"
    r")" + _EXT + r"(?![\w@]|[.-]\d)",
    re.ASCII,
)
OTHER_NUMBER = re.compile(r"(?:订货号|订单号|批次|批号|序列号|件号|型号|货号|料号|编号|版本|serial|order(?: code| no\.?| number)?|lot|batch|part no\.?|item|ref\.?|s/n|p/n|model|type)[ :：#.]*$", re.I)
ADDRESS_ZH = re.compile(
    r"(?:[\u4e00-\u9fff]{2,4}(?:省|自治区))?[\u4e00-\u9fff]{2,5}(?:市|州)(?:[\u4e00-\u9fff]{1,5}[区县旗镇乡]){0,2}[\u4e00-\u9fff]{1,8}?(?:大道|街道|大街|街|路|道|巷|弄|胡同)"
    r"[0-9０-９]+(?:-[0-9]+)?号(?:院)?(?:[0-9０-９]+(?:栋|号楼|幢|座|楼))?(?:[0-9０-９]+(?:单元))?(?:[0-9０-９]+(?:室|号房|层))?"
)
ADDRESS_CUE = re.compile(r".*(?:[至往在于到住址]|送货|快递)")
_STREET = "Street|Road|Lane|Avenue|Way|Drive|Court|Close|Square|Place|Terrace|Row|Boulevard|Crescent|Highway|Parkway|Quay|Walk|Yard|Hill|Gardens|Park"
_SHORT = "St|Rd|Ln|Ave|Av|Dr|Ct|Cl|Sq|Pl|Ter|Blvd|Cres|Hwy|Pkwy"
ADDRESS_EN = re.compile(
    r"(?<![\w.,-])(?:(?:Unit|Suite|Flat|Apt\.?|Apartment|Room|Floor)\.? ?#?\d{1,5}[A-Za-z]?,? )?\d{1,5}[A-Za-z]? (?:[A-Z][A-Za-z'’]+ ){1,4}?"
    rf"(?:(?:{_STREET})\b|(?:{_SHORT})\b\.?)"
    r"(?:,? (?:Unit|Suite|Flat|Apt\.?|#) ?\d{1,5})?"
    r"(?:, [A-Z][a-z'’]+(?:[ -][A-Z][a-z'’]+){0,2}(?:,? [A-Z]{2}(?=,? \d{5}))?(?:,? (?:\d{5}(?:-\d{4})?|[A-Z]{1,2}\d{1,2}[A-Z]? \d[A-Z]{2})\b)?)?"
)
ID_CUE = re.compile(
    r"(?:身份证(?:号码?)?|护照(?:号码?)?|证件(?:号码?)?|社保(?:卡)?号码?|保险号码?|passport(?: or identity)?(?: (?:number|no\.?))?|identity(?: card)?(?: (?:number|no\.?))?|\bID(?: card)?(?: (?:number|no\.?))?|national insurance(?: (?:number|no\.?))?|\bNI(?: (?:number|no\.?))|social security(?: (?:number|no\.?))?|SSN|insurance (?:number|no\.?))"
    r"[ :：#为是]*([A-Z]{0,2}\d(?:[ -]?\d){4,17}(?:[ -]?[A-Z](?![A-Za-z]))?)(?![\w])",
    re.I,
)
ID_CN = re.compile(r"(?<![\w-])[1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dX](?![\w-])", re.ASCII)
_CAP = r"[A-Z][A-Za-z'’-]+"
NAME_EN = rf"(?:{_CAP}, (?:{_CAP}|[A-Z]\.)(?: [A-Z]\.)?|(?:{_CAP}|[A-Z]\.)(?: [A-Z]\.)? {_CAP}(?:-{_CAP})?)"
TITLE_EN = rf"(?:{TITLES_EN}\.? )?"
LABEL = re.compile(r"(?m)(?:^|[.。;；!！?？])[ \t]*(?:编制|审核|批准|校对|联系人|收件人|姓名|Prepared by|Checked by|Approved by|Contact(?: person)?|Attn\.?|Name)[ \t]*[:：][ \t]*([^\n]*)$")
IN_SENTENCE = re.compile(
    rf"(?:\b[Bb]adge holder|\bsigned by|\b[Yy]esterday|\bcontact|\b[Cc]ontact|\bask for|\battention of|\bdear|\bDear|\bby|\bwith|\bcall|\bvisitor|\bengineer|\bMr\.?|\bMrs\.?|\bMs\.?|\bDr\.?)[ ]{TITLE_EN}(?P<n>(?:{_CAP}|[A-Z]\.)(?: [A-Z]\.)? {_CAP})(?=[ ]*(?:[,(;]|on\b|called\b|at\b|has\b|will\b|or\b|and\b|from\b|to\b|\.(?:\s|$)|$))"
)
GIVEN_NAME = re.compile(rf"\b(?P<g>[A-Z][a-z]+)(?: [A-Z]\.)? [A-Z][a-z]{{2,}}(?:-[A-Z][a-z]+)?\b")
ZH_BEFORE = re.compile(r"(?:联系人|收件人|验收人|经办人|负责人|持证人|请联系|可联系|联系|由|致电|转)[：: ]*(?P<n>[\u4e00-\u9fff]{2,4}?)(?=[，。；、,;）)（(\s]|负责|签收|女士|先生|$)")
ZH_AFTER = re.compile(rf"(?P<n>[\u4e00-\u9fff]{{2,4}})(?={TITLES_ZH})")
NOBODY = re.compile(r"(?i)^\W*(?:n/?a|none|unknown|tbd|to be (?:confirmed|determined)|see .*|待定|待确认|未知|无|不详|见.*|详见.*|-+|/+)\W*$")
NAME_HEAD = re.compile(r"(?i)^\s*(?:姓名|联系人|收件人|负责人|name|contact(?: person)?|person|employee)\s*$")
ID_HEAD = re.compile(r"(?i)(?:身份证|护照|证件|passport|identity|\bID\b|insurance)")

# What the detectors need, looked for in every text before they are run: substrings, found by one automaton, and patterns
# that begin with a small class. Each detector above has its cue here; both look at the rewritten characters.
CUES = (
    "@", "联系", "收件人", "验收人", "经办人", "负责", "持证人", "编制", "审核", "批准", "校对", "姓名", "致电", *TITLES_ZH.split("|"), "repared by", "hecked by", "pproved by", "ontact", "Attn", "Name", "adge holder", "signed by", "esterday", "ask for", "ttention of",
    "ear ", "Mr", "Ms", "Dr", " dot ", "\tdot ", " dot\t", "\tdot\t",
)
_NUMBER_WORD = r"(?i:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
_FAMILY_FIRST = "".join(sorted(FAMILY | {x[0] for x in FAMILY_TWO}))
CUE_PATTERNS = tuple(
    re.compile(p)
    for p in (
        r"[0-9](?:[ ().+-]{0,3}[0-9]){6}", r"[A-Z][a-z]+ (?:[A-Z]\. )?[A-Z][a-z]{2}", r"[A-Z](?<=[a-z.] [A-Z])(?:\.|[A-Za-z'’-]+)(?: [A-Z]\.)? [A-Z][A-Za-z'’-]", r"[0-9０-９]号",
        r"\d[A-Za-z]? (?:[A-Z][A-Za-z'’]+ ){1,4}(?:" + _STREET + "|" + _SHORT + r")\b", rf"[由转][：: ]*[{_FAMILY_FIRST}][\u4e00-\u9fff]{{1,3}}?(?=[，。；、,;）)（(\s]|负责|签收|女士|先生|$)",
    )
)
# Disguises that the transducer undoes; their letters and brackets are looked for in the source.
DISGUISE_CUES = tuple(
    re.compile(p) for p in (r"[(\[{<（【][ \t]{0,3}(?:at|AT|At|@|dot|DOT|Dot|\.)[ \t]{0,3}[)\]}>）】]", r"[零〇一二三四五六七八九]{7}", rf"[ \t-](?=[zotfsenZOTFSENſ]){_NUMBER_WORD}[ \t-]+{_NUMBER_WORD}[ \t-]")
)
ID_WORDS = ("身份证", "护照", "证件", "社保", "保险号", "passport", "identity", "id", "insurance", "ni ", "social security", "ssn")
FIVE_DIGITS = re.compile(r"\d(?:[ -]?\d){4}")
ID_CELL = re.compile(r"\d[\d -]{4}")
HEADS = re.compile(r"(?mi)^[^\S\n]*(?:name|contact(?: person)?|person|employee)[^\S\n]*$")
ODD_CHAR = re.compile("[^\\x00-\\x7f\\u4e00-\\u9fff，。、；“”‘’！？]")
PLAIN = str.maketrans({c: form for c, form in CHARS.items() if ODD_CHAR.match(c)})


@functools.lru_cache(maxsize=1)
def cue_automaton() -> ahocorasick.Automaton:
    cues = ahocorasick.Automaton()
    for cue in CUES:
        cues.add_word(cue, 1)
    cues.make_automaton()
    return cues


def maybe_personal(text: str) -> bool:
    """False only where no detector can find anything."""
    # without a disguise of several characters, the rewritten text is the mapped characters
    plain = text if text.isascii() or not ODD_CHAR.search(text) else text.translate(PLAIN)
    if next(cue_automaton().iter(plain), None) is not None or any(p.search(plain) for p in CUE_PATTERNS) or any(p.search(text) for p in DISGUISE_CUES):
        return True
    if not FIVE_DIGITS.search(plain):
        return False
    low = plain.casefold().replace("\u0307", "")
    return any(w in low for w in ID_WORDS) and bool(ID_CUE.search(plain))


def maybe_table(cells: str) -> bool:
    """The same for a table's cells, joined by line ends: what stands under a heading may have no cue of its own."""
    return maybe_personal(cells) or bool(HEADS.search(cells)) or bool(ID_CELL.search(cells) and ID_HEAD.search(cells))


def rewritten(text: str) -> tuple[str, list[int] | None, list[int] | None]:
    """(plain text, source start of each character, source end of each); None where nothing was rewritten."""
    out: list[str] = []
    low: list[int] = []
    high: list[int] = []
    at = 0
    for m in DISGUISE.finditer(text):
        kind = m.lastgroup
        if kind == "char":
            form = CHARS.get(m[0], m[0])
            if form == m[0]:
                continue
        elif kind == "spelled":
            words = re.split(r"[ \t-]+", m[0].lower())
            form = "".join(DIGIT_WORDS[w] for w in words) if words[0] in DIGIT_WORDS else "".join(HAN_DIGITS[c] for c in m[0])
        else:
            form = "@" if kind in ("at", "pat") else "."
        start, end = m.span()
        out.append(text[at:start])
        low.extend(range(at, start))
        high.extend(range(at + 1, start + 1))
        out.append(form)
        low.extend([start] * len(form))
        high.extend([end] * len(form))
        at = end
    if not out:
        return text, None, None
    out.append(text[at:])
    low.extend(range(at, len(text)))
    high.extend(range(at + 1, len(text) + 1))
    return "".join(out), low, high


def _zh_name(run: str, behind: bool) -> str:
    """The name at the end (before a title) or start of a run of Chinese characters."""
    if behind:
        for size in (4, 3, 2):
            part = run[-size:]
            if len(part) == size and (part[:2] in FAMILY_TWO if size == 4 else part[0] in FAMILY or part[:2] in FAMILY_TWO):
                return part
        return ""
    return run if run[:1] in FAMILY or run[:2] in FAMILY_TWO else ""


def _name_spans(text: str) -> Iterator[tuple[int, int]]:
    for m in LABEL.finditer(text):
        value = m[1]
        clean = re.sub(rf"^{TITLES_EN}\.?\s+", "", value.strip())
        clean = re.sub(rf"(?:\s*(?:{TITLES_ZH}))+$", "", clean)
        known = re.match(rf"(?:{NAME_EN}|[\u4e00-\u9fff](?:[ \u4e00-\u9fff]{{0,5}})[\u4e00-\u9fff])(?=\s*$|[，,;；(（/])", clean)
        if known and not NOBODY.match(clean):
            start = m.start(1) + value.index(known[0])
            yield start, start + len(known[0])
    for m in IN_SENTENCE.finditer(text):
        if m["n"].split()[0] not in ("The", "This", "With", "Each", "In", "If", "Do", "Before"):
            yield m.span("n")
    for m in GIVEN_NAME.finditer(text):
        if m["g"].lower() in GIVEN:
            yield m.span()
    for m in ZH_BEFORE.finditer(text):
        if name := _zh_name(re.sub(rf"(?:{TITLES_ZH})$", "", m["n"]), False):
            yield m.start("n"), m.start("n") + len(name)
    for m in ZH_AFTER.finditer(text):
        if name := _zh_name(m["n"], True):
            yield m.end("n") - len(name), m.end("n")


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of the pieces of personal information in ``text``, in its own offsets, without overlap."""
    plain, low, high = rewritten(text)
    found = [(*m.span(), "email") for m in EMAIL.finditer(plain)]
    found += [(*m.span(1), "id_number") for m in ID_CUE.finditer(plain)]
    found += [(*m.span(), "id_number") for m in ID_CN.finditer(plain) if not OTHER_NUMBER.search(plain[max(0, m.start() - 24) : m.start()])]
    for m in ADDRESS_ZH.finditer(plain):
        head = re.match(r"[\u4e00-\u9fff]+?(?:省|自治区|市|州)", m[0])
        cue = ADDRESS_CUE.match(head[0][:-1]) if head else None
        found.append((m.start() + (cue.end() if cue and cue.end() < len(head[0]) - 2 else 0), m.end(), "address"))
    found += [(*m.span(), "address") for m in ADDRESS_EN.finditer(plain)]
    for m in PHONE.finditer(plain):
        if not OTHER_NUMBER.search(plain[max(0, m.start() - 24) : m.start()]):
            found.append((*m.span(), "phone"))
    found += [(*s, "name") for s in _name_spans(plain)]
    # earlier kinds win over later ones where they overlap
    taken: list[tuple[int, int, str]] = []
    for start, end, kind in found:
        if start < end and all(end <= a or start >= b for a, b, _ in taken):
            taken.append((start, end, kind))
    if low is not None:
        taken = [(low[a], high[b - 1], kind) for a, b, kind in taken]
    return sorted(taken)


def _name_like(cell: str) -> bool:
    cell = cell.strip()
    if re.fullmatch(r"[\u4e00-\u9fff ]{2,5}", cell):
        bare = cell.replace(" ", "")
        return 2 <= len(bare) <= 4 and (bare[0] in FAMILY or bare[:2] in FAMILY_TWO)
    return bool(re.fullmatch(rf"{TITLE_EN}{NAME_EN}", cell)) and not NOBODY.match(cell)


def cell_spans(rows: list[list[str | None] | None] | None) -> list[tuple[int, int, int, int, str]]:
    """(row, cell, start, end, type) in a table; names also from the heading or from the company they keep."""
    out = []
    rows = [[c or "" for c in row or []] for row in rows or []]
    direct = [[spans(c) if len(c) > 1 else [] for c in row] for row in rows]
    heads = [bool(row) and any(NAME_HEAD.match(c) for c in row) for row in rows]
    personal = [any(k != "name" for cell in row for *_, k in cell) for row in direct]
    named: set[int] = set()
    for i, row in enumerate(rows):
        if heads[i]:
            named = {j for j, c in enumerate(row) if NAME_HEAD.match(c)}
        cue = {j for j, c in enumerate(rows[0]) if ID_HEAD.search(c)} if i else set()
        for j, cell in enumerate(row):
            got = direct[i][j]
            title = re.match(rf"\s*{TITLE_EN}", cell)
            if not got and not heads[i] and _name_like(cell) and (j in named or personal[i]):
                end = len(re.sub(rf"(?:\s*(?:{TITLES_ZH}))+\s*$", "", cell.rstrip()))
                got = [(title.end(), end, "name")]
            elif not got and j in cue and re.fullmatch(r"\s*[A-Z]{0,2}\d[\d -]{4,18}[A-Z]?\s*", cell):
                got = [(len(cell) - len(cell.lstrip()), len(cell.rstrip()), "id_number")]
            out += [(i, j, a, b, k) for a, b, k in got]
    return out


def _replace(text: str, parts: list[tuple[int, int, str]]) -> str:
    for start, end, kind in sorted(parts, reverse=True):
        text = f"{text[:start]}[{kind.upper()}]{text[end:]}"
    return text


def _joined_cells() -> Column:
    return F.array_join(F.flatten(F.filter("rows", lambda r: r.isNotNull())), "\n")


def find_personal(df: DataFrame, key: str = "row_id") -> DataFrame:
    """(key, field, pii_type, value): each different piece of a row's ``text`` (kind text) and of its ``rows``.

    Null, empty and blank texts, null cells and rows give nothing; repeated keys are searched each. A narrow plan: the
    texts and joined cells of a batch are looked over for cues, and only those with any are parsed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = batch.column(0), []
            for i, (text, cells) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                pieces = {("text", k, text[a:b]) for a, b, k in spans(text)} if text and maybe_personal(text) else set()
                if cells and maybe_table(cells):
                    rows = batch.column(3)[i].as_py()
                    pieces |= {("rows", k, rows[r][c][a:b]) for r, c, a, b, k in cell_spans(rows)}
                out += [(i, *p) for p in sorted(pieces)]
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(columns[0], pa.int64())), *(pa.array(c, pa.string()) for c in columns[1:])], names=[key, "field", "pii_type", "value"])

    rows = df.select(F.col(key), F.when(F.col("kind") == "text", F.col("text")).alias("_text"), _joined_cells().alias("_cells"), F.col("rows").alias("_rows"))
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *(T.StructField(n, T.StringType()) for n in ("field", "pii_type", "value"))])
    return rows.where("_text <> '' OR _cells <> ''").mapInArrow(run, schema)


def redact(df: DataFrame, key: str = "row_id") -> DataFrame:
    """(key, text, rows) of every row, personal information replaced by [NAME], [PHONE], [EMAIL], [ADDRESS], [ID_NUMBER]."""
    table = T.ArrayType(T.ArrayType(T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, tables = [], []
            for i, (text, searched, cells) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                texts.append(_replace(text, spans(text)) if text and searched and maybe_personal(text) else text)
                rows = batch.column(4)[i].as_py()
                if cells and maybe_table(cells):
                    parts: dict[tuple[int, int], list] = {}
                    for r, c, a, b, k in cell_spans(rows):
                        parts.setdefault((r, c), []).append((a, b, k))
                    rows = [row if row is None else [_replace(x, parts[r, c]) if (r, c) in parts else x for c, x in enumerate(row)] for r, row in enumerate(rows)]
                tables.append(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(tables, pa.list_(pa.list_(pa.string())))], names=[key, "text", "rows"])

    rows = df.select(F.col(key), F.col("text").alias("_text"), (F.col("kind").eqNullSafe("text")).alias("_search"), _joined_cells().alias("_cells"), F.col("rows").cast(table).alias("_rows"))
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("text", T.StringType()), T.StructField("rows", table)])
    return rows.mapInArrow(run, schema)
