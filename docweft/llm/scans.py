"""Problem 4: noise in the text of scanned pages, found line by line and repaired.

A page is a sequence of lines. A hidden Markov model labels each line as header, number (the page's own), body or
break (the end of a paragraph), from layout features: the place on the page, the width, the mark at the end, and
whether the line recurs on other pages of the document up to case and misreading. It starts from labels that simple
rules give, and is fitted to all pages by expectation and maximisation; decoding is Viterbi's. Paragraphs are put
together from the labels.

What a word should be is learned from the corpus of pages: a rare form is misread if undoing a confusion of characters
gives a form that is many times as frequent. Words broken at line ends are told from compounds by the same counts.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweft.session import cut_lineage

# What a scanner's recognition reads for what is printed.
CONFUSED = (
    ("c", "e"), ("0", "o"), ("1", "l"), ("1", "i"), ("l", "i"), ("i", "l"), ("5", "s"), ("b", "h"), ("h", "b"), ("q", "g"), ("9", "g"), ("cl", "d"), ("vv", "w"), ("rn", "m"), ("r", "n"), ("v", "u"), ("u", "v"), ("8", "b"), ("6", "b"), ("e", "c"), ("d", "cl"), ("m", "rn"),
    ("ii", "u"), ("li", "h"), ("t", "f"), ("f", "t"), ("n", "u"), ("u", "n"), ("o", "c"), ("y", "v"), ("j", "i"), ("2", "z"), ("i", "j"), ("nn", "m"), ("o", "a"), ("a", "o"),
)
# Chinese characters of similar shape; the first of two is what is often read for the second.
SIMILAR = (
    "屯电 处外 扳板 休体 铀轴 朋期 朋明 兔免 庄压 坐座 瑞端 人入 入人 蜜密 闾间 未末 末未 己已 已己 日目 目日 曰日 土士 士土 千干 干千 于干 天夫 夫天 大太 太大 犬大 王玉 玉王 主王 木本 本木 力刀 刀力 几儿 九丸 白自 自白 甲申 申甲 由田 田由 "
    "贝见 见贝 冰水 水永 永水 今令 令今 免兔 侯候 候侯 拔拨 拨拔 折拆 拆折 折析 析折 侍待 待侍 洒酒 酒洒 晴睛 睛晴 栽裁 裁栽 徒徙 幕慕 慕幕 赢羸 眯咪 戊戌 戌戊 祟崇 崇祟 辨辩 辩辨 状壮 壮状 住佳 佳住 往住 住往 即既 既即 冶治 治冶 泪汨 "
    "竞竟 竟竞 暖暧 侧测 测侧 侧则 则测 管菅 萧箫 杆秆 杆扦 抢枪 枪抢 扫归 括活 活括 技枝 枝技 析柝 陪部 部陪 郎朗 朗郎 间问 问间 问向 向问 闭闲 闲闭 阀阅 阅阀 阔阀 肪防 防肪 防妨 妨防 仿防 泵秉 柰奈 录彔 叶汁 汁叶 孔扎 扎孔 孑子 子孑 仓仑 仑仓 "
    "弓号 号弓 启后 名各 各名 台合 合台 舍含 含舍 合含 吕品 品吕 困因 因困 囚因 固同 同固 园圆 圆园 团困 员负 负员 货贷 贷货 质贡 货质 赁货 查杳 杏查 香查 查香 季李 李季 委秀 秀委 秤杆 称秤 秤称 种钟 钟种 针计 计针 讦计 汁计 订仃 钉订 订钉 "
    "官宫 宫官 宜宣 宣宜 定宝 宝定 宁守 守宁 安宋 密蜜 家冢 容客 客容 密宓 弃奔 异导 导异 寻导 早旱 旱早 昌冒 冒昌 易昜 晶品 曲由 更史 史更 吏更 来米 米来 束来 东车 车东 乐东 东乐 末来 压庄 厌压 灰压 床庄 座坐 度庋 库厍 库厙 启居 居启 层屋 屋层 "
    "性牲 牲性 牧收 收牧 攻政 政攻 故敌 敌故 效郊 救求 教孝 数敦 温湿 湿温 温盖 渴喝 喝渴 滑猾 液夜 夜液 流沠 油抽 抽油 油由 注往 注住 住注 沈沉 沉沈 冷泠 冲仲 仲冲 决快 快决 准淮 淮准 凉谅 减咸 减滅 次欠 欠次 炎灸 炙灸 热执 执热 烧绕 绕烧 "
    "线钱 钱线 绝色 续读 读续 维雏 罐灌 灌罐 缘绿 绿缘 网冈 冈网 两雨 雨两 而面 面而 靣面 血皿 皿血 盆盒 盒盆 益盖 盖益 盘盆 监临 临监 蓝篮 篮蓝 节苄 荐存 存荐 存在 在存 布市 市布 常党 带常 帽慣 干十 午牛 牛午 年午 平乎 乎平 升开 开升 井并 并井 "
)
SHAPES: dict[str, set[str]] = {}
for _pair in SIMILAR.split():
    SHAPES.setdefault(_pair[0], set()).add(_pair[1])

#: A form is misread if its correction is at least so many times as frequent, and seen so often.
RATIO, LEAST = 8, 3
#: The same for Chinese characters of similar shape, of which one reading may make a tenth of all.
SHAPE_RATIO = 3
#: Corrections that are handed to all workers at once; beyond that number they are joined instead.
BROADCAST_FORMS = 200_000
#: A title line recurs on so many pages of the document.
PAGES = 3
#: A title that may be a sentence, too, stands apart on at least one of so many pages that it recurs on.
APART = 3
READ_DIGITS = str.maketrans("OlISB", "01158")
MARK = r"[-‐‑¬­]"
MARKS = "-\u2010\u2011\xac\xad"
LAST_WORD = re.compile(r"[A-Za-z0-9]+$")
WORDS = re.compile(r"[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*")
NUMBER_SEEN = re.compile(r"(?<![A-Za-z0-9])(?=[0-9OlISB]*\d)(?=[0-9OlISB]*[OlISB])[0-9OlISB]+(?![A-Za-z0-9])")
NUMBER_READ = re.compile(r"(?=.*\d)(?=.*[OlISB])[0-9OlISB]+")
ODD_ENDS = re.compile("[\r\u2028\u2029]")
HAN_RUN = re.compile("[一-鿿]+")
HAN = re.compile("[一-鿿]")
TOKEN = re.compile("[A-Za-z0-9]+")
NUMBER_LINE = re.compile(
    r"\s*(?:第\s*(?P<a>\d+)\s*[页頁](?:\s*[/／,，]?\s*共\s*\d+\s*[页頁])?|(?:page|p|pg|seite|s)\s*[.:]?\s*(?P<b>\d+)(?:\s*(?:/|of|von)\s*\d+)?|[-–—·•|\[(<~\s]*(?P<c>\d+)[-–—·•|\])>~\s]*|(?P<d>\d+)\s*(?:/|of|／)\s*\d+)\s*", re.I
)
_FOLD = str.maketrans({"0": "o", "1": "l", "i": "l", "j": "l", "5": "s", "e": "c", "9": "g", "q": "g", "h": "b", "u": "v", "r": "n", "8": "b"})
_CJK_FOLD = {ord(a): min({a, *b}, key=lambda x: (x not in "电外板体轴期明免压座端入密间", x)) for a, b in SHAPES.items()}


def folded(line: str) -> str:
    """A line or word up to case, width, spaces, punctuation and misreading."""
    line = unicodedata.normalize("NFKC", line).casefold()
    line = "".join(c for c in line if c.isalnum())
    return line.replace("vv", "w").replace("rn", "m").replace("cl", "d").translate(_FOLD).translate(_CJK_FOLD)


def is_number_line(line: str, page: int) -> bool:
    """Whether the line only gives the page's number."""
    line = line.strip()
    m = NUMBER_LINE.fullmatch(line if len(line) <= 40 else " ".join(line.split()))
    # digits beyond what int() reads are no page's number
    return bool(m) and len(number := next(g for g in m.groups() if g)) <= 4000 and int(number) == page


#: A line that goes on in the next one.
OPEN_END = re.compile(r"(?i)\b(?:the|an?|of|to|and|or|but|with|for|in|on|by|from|is|are|that)$")


def lines_of(text: str) -> list[str]:
    return text.split("\n") if not ODD_ENDS.search(text) else re.split(r"\r\n|\r|\n|\u2028|\u2029", text)


def broken_end(line: str) -> tuple[str, str] | None:
    """(last word, mark) of a line that ends with a mark right behind a word."""
    bare = line.rstrip(" \t")
    word = LAST_WORD.search(bare[-101:-1]) if bare and bare[-1] in MARKS else None
    return (word[0], bare[-1]) if word else None


def edge_lines(lines: list[str], page: int) -> list[int]:
    """Indexes of the lines at the head and foot of a page, the page's number set aside."""
    full = [i for i, x in enumerate(lines) if x.strip() and not is_number_line(x, page)]
    return sorted({*full[:2], *full[-2:]})


def title_like(line: str) -> int:
    """2 for a line without any mark of a sentence, 1 for one that at least begins and ends like a title, else 0."""
    line = line.strip()
    if line[:1].islower() or re.search(r"[。！？]|[，；,;!?.:：]$", line):
        return 0
    return 1 if re.search(r"[。，；！？,;!?的了得]|\b(?:the|is|are|that|to|can|be|has|have|so|but|because|which|and|with)\b", line, re.I) else 2


def stands_apart(lines: list[str], i: int, page: int) -> bool:
    """Whether line ``i`` is laid out as a title, not as a line of the text it borders on: outermost on its page, and
    off the text by a blank line, by its width, or as the line below begins anew."""
    full = [k for k, x in enumerate(lines) if x.strip() and not is_number_line(x, page)]
    k, line = full.index(i), lines[i].strip()
    foot = k and k >= len(full) - 2
    beyond = full[k + 1 :] if foot else full[:k]
    if len(full) < 3 or broken_end(line) or OPEN_END.search(line) or (beyond and (len(beyond) > 1 or not title_like(lines[beyond[0]]))):
        return False
    inner = full[k - 1] if foot else full[k + 1]
    if any(not x.strip() for x in lines[min(i, inner) + 1 : max(i, inner)]):
        return True
    widths = sorted(len(lines[x].strip()) for x in full)
    return len(line) < 0.7 * widths[len(widths) // 2] or (not foot and lines[inner].strip()[0].isupper())


def is_title(lines: list[str], i: int, page: int) -> bool:
    """Whether line ``i`` reads and stands like a title, and the text goes on anew behind it."""
    following = next((x.strip() for x in lines[i + 1 :] if x.strip()), "")
    return title_like(lines[i]) == 2 and stands_apart(lines, i, page) and not following[:1].islower()


def page_table(df: DataFrame, key: str) -> DataFrame:
    """(_key, _document, _page, _text) of the rows that hold a whole scanned page."""
    page = F.regexp_extract("location", r"^page:(\d{1,9})/ocr$", 1)
    return df.where((page != "") & F.col("text").rlike(r"\S")).select(F.col(key).alias("_key"), F.coalesce("document", F.concat(F.lit("?"), F.col(key).cast("string"))).alias("_document"), page.cast("int").alias("_page"), F.col("text").alias("_text"))


def _map(df: DataFrame, each: Callable[[dict], list[tuple]], schema: str, names: list[str], types: list[pa.DataType]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [x for row in batch.to_pylist() for x in each(row)]
            columns = list(zip(*out, strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return df.mapInArrow(run, schema)


def recurring_lines(pages: DataFrame, key_type: str) -> DataFrame:
    """(_key, _titles): indexes of a page's lines that recur at the head or foot of other pages of the document."""

    def edges(row: dict) -> list[tuple]:
        lines, out = lines_of(row["_text"]), []
        for i in edge_lines(lines, row["_page"]):
            form = folded(lines[i])
            if 3 <= len(form) <= 120:
                words = [folded(w) for w in lines[i].split()] if " " in lines[i].strip() else list(form)
                keys = {form} | ({"|".join(words[:k] + ["*"] + words[k + 1 :]) for k in range(len(words))} if 3 <= len(words) <= 24 else set())
                title = title_like(lines[i])
                apart = title == 1 and stands_apart(lines, i, row["_page"])
                out += [(row["_key"], row["_document"], row["_page"], i, form == x, title, int(apart), x) for x in sorted(keys)]
        return out

    arrow = pa.int64() if key_type == "bigint" else pa.string()
    rows = _map(pages, edges, f"_key {key_type}, _document string, _page int, _line int, _whole boolean, _title int, _apart int, _form string", ["_key", "_document", "_page", "_line", "_whole", "_title", "_apart", "_form"], [arrow, pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.string()])
    rows = cut_lineage(rows.withColumn("_form", F.xxhash64("_form")))
    # pages are counted once however often they were delivered: first by page, then over pages
    seen = rows.groupBy("_document", "_form", "_page").agg(F.max("_title").alias("_title"), F.max("_apart").alias("_apart"))
    seen = seen.groupBy("_document", "_form").agg(F.count("*").alias("_n"), F.max("_title").alias("_title"), F.sum("_apart").alias("_apart")).where(f"_n >= {PAGES}")
    # what may be a sentence, too, has to stand apart on so many pages, and not just by chance
    seen = seen.where(f"_title = 2 OR (_title = 1 AND _apart >= {PAGES} AND {APART} * _apart >= _n)").select("_document", "_form")
    return rows.join(seen, ["_document", "_form"], "left_semi").groupBy("_key").agg(F.sort_array(F.collect_set("_line")).alias("_titles"))


def _grams(text: str, page: int, words: Counter, triples: Counter) -> None:
    """Counts words and compounds, and Chinese characters with their neighbours, of the lines that aren't the page's number."""
    lines = [x.strip() for x in lines_of(text) if x.strip() and not is_number_line(x, page)]
    cut = False
    for line in lines:
        found = WORDS.findall(line)
        if cut:
            found = found[1:]
        cut = bool(broken_end(line))
        if cut:
            found = found[:-1]
        words.update(found)
    run = re.sub(r"\d+", "0", "".join(lines))
    for m in HAN_RUN.finditer(run):
        a, b = m.span()
        part = (run[a - 1] if a else "^") + m[0] + (run[b] if b < len(run) else "$")
        triples.update(zip(part, part[1:], part[2:], strict=False))


def _named_grams(words: Counter, triples: Counter) -> Counter:
    """Grams by what they are: w a word, c a compound, t a character between its neighbours."""
    out = Counter({"t" + "".join(k): n for k, n in triples.items()})
    for word, n in words.items():
        if not re.match(r"\d+[A-Z]", word):  # else a number with its unit
            low = word.lower()
            if "-" in low:
                out["c" + folded(low)] += n
            for part in low.split("-"):
                out["w" + part] += n
    return out


def vocabulary(pages: DataFrame) -> DataFrame:
    """(_gram, _n) over all pages, counted before the exchange."""

    def emit(words: Counter, triples: Counter) -> pa.RecordBatch:
        total = _named_grams(words, triples)
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["_gram", "_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, triples = Counter(), Counter()
        for batch in batches:
            for page, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _grams(text, page, words, triples)
            if len(words) + len(triples) > 300_000:  # bounds what a worker holds
                yield emit(words, triples)
                words, triples = Counter(), Counter()
        yield emit(words, triples)

    return cut_lineage(pages.select("_page", "_text").mapInArrow(run, "_gram string, _n bigint").groupBy("_gram").agg(F.sum("_n").alias("_n")))


def undone(word: str) -> list[str]:
    """The forms that ``word`` may have been read for: one or two confusions undone."""
    first = {word[:i] + b + word[i + len(a) :] for a, b in CONFUSED for i in range(len(word)) if word.startswith(a, i)}
    if len(word) <= 20:
        first |= {w[:i] + b + w[i + len(a) :] for w in [*first] for a, b in CONFUSED[:19] for i in range(len(w)) if w.startswith(a, i)}
    first.discard(word)
    return sorted(first)


def corrections(grams: DataFrame) -> DataFrame:
    """(_gram, _right): each misread form and what it stands for."""
    words = grams.where("_gram LIKE 'w%' AND length(_gram) BETWEEN 3 AND 40")
    # a form that is frequent itself can't be dominated: the largest count bounds what a correction may have
    most = words.agg(F.max("_n")).collect()[0][0] or 0
    rare = words.where((F.col("_n") * RATIO <= most) & F.col("_gram").rlike("^w[0-9]*[a-z]"))

    def options(row: dict) -> list[tuple]:
        return [(row["_gram"], row["_n"], "w" + x) for x in undone(row["_gram"][1:]) if x.isalpha()]

    tried = _map(rare.select("_gram", "_n"), options, "_gram string, _n bigint, _right string", ["_gram", "_n", "_right"], [pa.string(), pa.int64(), pa.string()])
    known = words.select(F.col("_gram").alias("_right"), F.col("_n").alias("_of"))
    best = tried.join(known, "_right").where(f"_of >= {LEAST} AND _of >= {RATIO} * _n").groupBy("_gram").agg(F.max_by("_right", F.struct("_of", "_right")).alias("_right"))

    # Chinese: a character among its neighbours. Pairs of similar shape are judged by either neighbour.
    three = grams.where("_gram LIKE 't%'").select("_gram", "_n", F.substring("_gram", 2, 1).alias("_l"), F.substring("_gram", 3, 1).alias("_c"), F.substring("_gram", 4, 1).alias("_r"))
    three = cut_lineage(three)
    left = three.groupBy("_l", "_c").agg(F.sum("_n").alias("_n"))
    right = three.groupBy("_c", "_r").agg(F.sum("_n").alias("_n"))
    alike = F.broadcast(grams.sparkSession.createDataFrame([(a, b) for a, others in SHAPES.items() for b in sorted(others)], "_c string, _for string"))  # the fixed list above
    pairs = three.join(alike, "_c")
    for side, table in (("_l", left), ("_r", right)):
        own = table.select(side, "_c", F.col("_n").alias(f"_own{side}"))
        other = table.select(side, F.col("_c").alias("_for"), F.col("_n").alias(f"_for{side}"))
        pairs = pairs.join(own, [side, "_c"], "left").join(other, [side, "_for"], "left").fillna(0, [f"_own{side}", f"_for{side}"])
    rules = [f"_for{x} >= {LEAST} AND _for{x} >= {SHAPE_RATIO} * _own{x}" for x in ("_l", "_r")]
    wrong = pairs.where(f"({rules[0]} AND _for_r >= _own_r) OR ({rules[1]} AND _for_l >= _own_l)")
    wrong = wrong.groupBy("_gram").agg(F.max_by("_for", F.struct(F.col("_for_l") + F.col("_for_r"), "_for")).alias("_for"))
    # other pairs are induced: characters that the same one dominates in most of the frames they stand in
    top = three.groupBy("_l", "_r").agg(F.max(F.struct("_n", "_c")).alias("_top"))
    ruled = three.join(top, ["_l", "_r"]).where(f"_top._c <> _c AND _top._n >= {LEAST} AND _top._n >= {RATIO} * _n")
    total = three.groupBy("_c").agg(F.sum("_n").alias("_all"))
    induced = ruled.groupBy("_c", F.col("_top._c").alias("_for")).agg(F.sum("_n").alias("_sum"), F.count("*").alias("_frames")).join(total, "_c").where("_frames >= 3 AND 2 * _sum >= _all")
    also = ruled.withColumn("_for", F.col("_top._c")).join(induced.select("_c", "_for"), ["_c", "_for"], "left_semi").select("_gram", "_for")
    wrong = wrong.unionByName(also).groupBy("_gram").agg(F.first("_for").alias("_for"))
    return cut_lineage(best.unionByName(wrong.select("_gram", F.concat(F.lit("t"), "_for").alias("_right"))))


def broken_words(pages: DataFrame, grams: DataFrame, key_type: str) -> DataFrame:
    """(_key, _breaks): indexes of lines whose last word a foreign mark breaks."""

    def ends(row: dict) -> list[tuple]:
        lines, out = lines_of(row["_text"]), []
        for i, line in enumerate(lines):
            if m := broken_end(line):
                following = next((x for x in lines[i + 1 :] if x.strip() and not is_number_line(x, row["_page"])), "")
                if (n := re.match(r"\s*([A-Za-z0-9]+)", following)) and re.search("[A-Za-z]", m[0]) and re.search("[A-Za-z]", n[1]):
                    out.append((row["_key"], i, m[1], "w" + (m[0] + n[1]).lower(), "c" + folded(m[0] + n[1])))
        return out

    arrow = pa.int64() if key_type == "bigint" else pa.string()
    rows = _map(pages.select("_key", "_page", "_text"), ends, f"_key {key_type}, _line int, _mark string, _joined string, _compound string", ["_key", "_line", "_mark", "_joined", "_compound"], [arrow, pa.int32(), pa.string(), pa.string(), pa.string()])
    joined = grams.where("_gram LIKE 'w%'").select(F.col("_gram").alias("_joined"), F.col("_n").alias("_word"))
    compound = grams.where("_gram LIKE 'c%'").select(F.col("_gram").alias("_compound"), F.col("_n").alias("_own"))
    rows = rows.join(joined, "_joined", "left").join(compound, "_compound", "left")
    # only a hyphen can be a compound's own
    foreign = ~F.col("_mark").isin("-", "‐", "‑") | (F.coalesce("_own", F.lit(0)) <= F.coalesce("_word", F.lit(0)))
    return rows.where(foreign).groupBy("_key").agg(F.sort_array(F.collect_set("_line")).alias("_breaks"))


LABELS = ("header", "number", "body", "break")


END_STOP = re.compile(r"[.。!?！？:：][\"”’」]?\s*$")


def features(lines: list[str], page: int, titles: set[int]) -> list[tuple[str, ...]]:
    full = [i for i, x in enumerate(lines) if x.strip()]
    widths = sorted(len(lines[i]) for i in full)
    usual = widths[len(widths) // 2] if widths else 1
    head, foot = set(full[:2]), set(full[-2:])
    out = []
    for i, line in enumerate(lines):
        if not line.strip():
            out.append(("recurs=False", "number=False", "place=blank", "width=none", "end=open"))
            continue
        place = "place=first" if i in head else "place=last" if i in foot else "place=middle"
        width = "width=short" if len(line) < 0.7 * usual else "width=full"
        end = "end=stop" if END_STOP.search(line) else "end=open"
        out.append(("recurs=True" if i in titles else "recurs=False", "number=True" if is_number_line(line, page) else "number=False", place, width, end))
    return out


def ruled(feature: tuple[str, ...]) -> str:
    """The label that simple rules give: what the model's counts start from."""
    if feature[2] == "place=blank":
        return "break"
    if feature[1] == "number=True":
        return "number"
    if feature[0] == "recurs=True" and feature[2] != "place=middle":
        return "header"
    return "break" if feature[3:] == ("width=short", "end=stop") else "body"


GROUPS = (("recurs=True", "recurs=False"), ("number=True", "number=False"), tuple(f"place={x}" for x in ("blank", "first", "last", "middle")), tuple(f"width={x}" for x in ("none", "short", "full")), ("end=stop", "end=open"))
#: Rounds of expectation and maximisation over all pages.
ROUNDS = 2


def _probabilities(counts: dict[tuple[str, str], float]) -> dict[str, dict[str, float]]:
    """Log probabilities of transitions ("a>") and features from counts of (label, label) and (label, feature)."""
    model: dict[str, dict[str, float]] = {}
    for a in ("start", *LABELS):
        follow = {b: counts.get((a, b), 0) + 0.5 for b in LABELS}
        model[f"{a}>"] = {b: math.log(n / sum(follow.values())) for b, n in follow.items()}
    for a in LABELS:
        for group in GROUPS:
            seen = {v: counts.get((a, v), 0) + 0.05 for v in group}
            model.setdefault(a, {}).update({v: math.log(n / sum(seen.values())) for v, n in seen.items()})
    return model


def expectations(pages: list[list[tuple[str, ...]]], model: dict[str, dict[str, float]]) -> dict[tuple[str, str], float]:
    """Expected counts of (label, label) and (label, feature) over pages of line features, by forward-backward; pages of
    the same number of lines are computed together."""
    total: Counter = Counter()
    start = np.exp([model["start>"][b] for b in LABELS])
    step = np.exp([[model[f"{a}>"][b] for b in LABELS] for a in LABELS])
    kinds: dict[tuple[str, ...], int] = {}
    lengths: dict[int, list[list[int]]] = {}
    for page in pages:
        if page:
            lengths.setdefault(len(page), []).append([kinds.setdefault(f, len(kinds)) for f in page])
    own = np.exp([[sum(model[a][v] for v in f) for a in LABELS] for f in kinds])
    held = np.zeros((len(kinds), len(LABELS)))
    for size, rows in lengths.items():
        seen = np.array(rows)
        emit = own[seen]
        ahead, back = np.empty_like(emit), np.ones_like(emit)
        ahead[:, 0] = start * emit[:, 0]
        ahead[:, 0] /= ahead[:, 0].sum(1, keepdims=True)
        for t in range(1, size):
            ahead[:, t] = (ahead[:, t - 1] @ step) * emit[:, t]
            ahead[:, t] /= ahead[:, t].sum(1, keepdims=True)
        for t in range(size - 2, -1, -1):
            back[:, t] = (emit[:, t + 1] * back[:, t + 1]) @ step.T
            back[:, t] /= back[:, t].sum(1, keepdims=True)
            pair = ahead[:, t, :, None] * step * (emit[:, t + 1] * back[:, t + 1])[:, None, :]
            moved = (pair / pair.sum((1, 2), keepdims=True)).sum(0)
            total.update({(a, b): moved[i, j] for i, a in enumerate(LABELS) for j, b in enumerate(LABELS)})
        both = ahead * back
        both /= both.sum(2, keepdims=True)
        total.update({("start", b): n for b, n in zip(LABELS, both[:, 0].sum(0), strict=True)})
        np.add.at(held, seen, both)
    for f, k in kinds.items():
        for a, n in zip(LABELS, held[k], strict=True):
            total.update({(a, v): n for v in f})
    return total


def line_model(pages: DataFrame) -> dict[str, dict[str, float]]:
    """Log probabilities of transitions and features, fitted to all pages by expectation and maximisation.

    The first counts are those of simple rules. Each round counts what the model itself expects; as the rules' counts are
    the prior, they stay in the sum, and the labels keep their meaning. The counts have at most a few hundred different entries (labels x labels, labels x feature values), which
    are read to the driver. Without any page all are alike.
    """

    def counted(model: dict[str, dict[str, float]] | None) -> Counter:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: Counter = Counter()
            for batch in batches:
                seen = [features(lines_of(row["_text"]), row["_page"], set(row["_titles"] or [])) for row in batch.to_pylist()]
                if model is not None:
                    total.update(expectations(seen, model))
                    continue
                for page in seen:
                    before = "start"
                    for f in page:
                        label = ruled(f)
                        total[before, label] += 1
                        total.update((label, value) for value in f)
                        before = label
            pairs = list(total)
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string()), pa.array([float(n) for n in total.values()], pa.float64())], names=["a", "b", "n"])

        rows = pages.mapInArrow(run, "a string, b string, n double").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
        # rounded, as sums of fractions depend on the order of tasks
        return Counter({(r.a, r.b): round(r.n, 3) for r in rows})

    prior = counted(None)
    model = _probabilities(prior)
    for _ in range(ROUNDS):
        model = _probabilities(prior + counted(model))
    return model


def decode(seen: list[tuple[str, ...]], model: dict[str, dict[str, float]]) -> list[str]:
    """The most likely labels (Viterbi)."""
    if not seen:
        return []
    size = range(len(LABELS))
    step = [[model[f"{a}>"][b] for a in LABELS] for b in LABELS]
    known: dict[tuple[str, ...], list[float]] = {}
    score, back = [model["start>"][b] for b in LABELS], []
    for k, f in enumerate(seen):
        own = known.get(f)
        if own is None:
            own = known[f] = [sum(model[b][v] for v in f) for b in LABELS]
        if k:
            options = [[score[a] + step[b][a] for a in size] for b in size]
            best = [max(o) for o in options]
            back.append([o.index(x) for o, x in zip(options, best, strict=True)])
            score = [x + y for x, y in zip(best, own, strict=True)]
        else:
            score = [x + y for x, y in zip(score, own, strict=True)]
    last = score.index(max(score))
    out = [last]
    for choice in reversed(back):
        out.append(last := choice[last])
    return [LABELS[x] for x in reversed(out)]


class Corrections:
    """Misread forms and what they stand for, with a quick look whether a text may hold any."""

    def __init__(self, right: dict[str, str]) -> None:
        self.right = right
        self.words = {k[1:] for k in right if k[0] == "w"}
        middle = sorted({k[2] for k in right if k[0] == "t"})
        self.suspect = re.compile("[" + "".join(middle) + "]") if middle else None

    def may_hold(self, text: str) -> bool:
        return bool(self.suspect and self.suspect.search(text)) or not self.words.isdisjoint(TOKEN.findall(text.lower())) or bool(NUMBER_SEEN.search(text))


class Lookups(Corrections):
    """Corrections of nothing, that note what is looked up."""

    def __init__(self) -> None:
        self.seen: set[str] = set()
        self.right = self.words = self
        self.suspect = HAN

    def may_hold(self, text: str) -> bool:
        return True

    def get(self, gram: str) -> None:
        self.seen.add(gram)

    def __contains__(self, word: str) -> bool:
        self.seen.add("w" + word)
        return False


def misread_in(line: str, known: Corrections, before: str = "^", after: str = "$", skip: tuple[bool, bool] = (False, False)) -> tuple[str, bool]:
    """(the line with its misread words, numbers and characters corrected, whether there were any)."""
    found, right = False, known.right
    if known.suspect and known.suspect.search(line):
        masked = re.sub(r"\d", "0", before + line + after)
        chars = list(line)
        for m in known.suspect.finditer(line):
            if good := right.get("t" + masked[m.start() : m.start() + 3]):
                chars[m.start()], found = good[1:], True
        line = "".join(chars)
    tokens = list(TOKEN.finditer(line))
    for k in range(len(tokens) - 1, -1, -1):
        if (skip[0] and k == 0) or (skip[1] and k == len(tokens) - 1):
            continue
        w = tokens[k][0]
        if NUMBER_READ.fullmatch(w):
            good = w.translate(READ_DIGITS)
        elif w.lower() in known.words and not re.match(r"\d+[A-Z]", w):
            good = right["w" + w.lower()][1:]
            good = good.upper() if w.isupper() and len(w) > 1 else good.capitalize() if w[0].isupper() else good
        else:
            continue
        found = True
        line = line[: tokens[k].start()] + good + line[tokens[k].end() :]
    return line, found


def repair(text: str, page: int, titles: set[int], breaks: set[int], known: Corrections, model: dict) -> tuple[str, list[str]]:
    """(continuous text, kinds of noise present)."""
    lines, look = lines_of(text), known.may_hold(text)
    labels = decode(features(lines, page, titles), model)
    # what the model takes for a header but no other page repeats may be a title of this page: a paragraph of its own
    labels = [x if x != "header" or i in titles else "title" if is_title(lines, i, page) else "body" for i, x in enumerate(labels)]
    noise = {"header" for x in labels if x == "header"} | {"page_number" for x in labels if x == "number"}
    body = [(i, lines[i].strip(), labels[i]) for i in range(len(lines)) if labels[i] in ("body", "break", "title") and (lines[i].strip() or labels[i] == "break")]
    filled = [(i, x, label) for i, x, label in body if x]
    context = {i: ((filled[k - 1][1] or "^")[-1] if k else "^", (filled[k + 1][1] or "$")[0] if k + 1 < len(filled) else "$") for k, (i, _, _) in enumerate(filled)}
    paragraphs: list[str] = []
    current, glue, stem = "", "", ""  # stem: a broken word so far, as it was read
    for k, (i, line, label) in enumerate(body):
        if not line:
            if current and glue == "":
                paragraphs.append(current)
                current = ""
            continue
        broken = broken_end(line)
        if label == "title" and current and glue == "" and not broken:
            paragraphs.append(current)
            current = ""
        fixed, wrong = misread_in(line, known, *context[i], skip=(glue == "-", bool(broken))) if look else (line, False)
        if glue == "-":  # the joined word is looked up as a whole
            head, tail = re.search(r"[A-Za-z0-9]*$", current)[0], re.match(r"[A-Za-z0-9]*", fixed)[0]
            stem += tail
            good = known.right.get("w" + stem.lower())
            if good or NUMBER_READ.fullmatch(stem):
                wrong = True
                fixed = fixed[len(tail) :]
                current = current[: len(current) - len(head)] + (good[1:] if good else head + tail)
            current += fixed
        else:
            spaced = current and not (re.search(r"[　-鿿＀-￯]$", current) or re.match(r"[　-鿿＀-￯]", fixed)) and not current.endswith("-")
            current += (" " if spaced else "") + fixed
        if wrong:
            noise.add("misread")
        glued, glue = glue == "-", ""
        if broken and i in breaks:
            noise.add("hyphenation")
            whole = re.fullmatch(rf"[A-Za-z0-9]+{MARK}", line) and glued
            current, glue = re.sub(rf"{MARK}[ \t]*$", "", current), "-"
            stem = stem if whole else re.search(r"[A-Za-z0-9]*$", current)[0]
        elif broken:
            current = current.rstrip()
        elif label == "title" or label == "break" and not (k + 1 < len(body) and body[k + 1][1][:1].islower()):
            paragraphs.append(current)
            current = ""
    if current:
        paragraphs.append(current)
    return "\n\n".join(paragraphs), sorted(noise)


def repaired_pages(df: DataFrame, key: str = "row_id") -> DataFrame:
    """(key, text, noise ARRAY<STRING>) of every row that holds a whole scanned page.

    Blank and null texts are no pages. A page delivered several times is several rows but one page of its document.
    A row without a document is a document of its own.
    """
    key_type = df.schema[key].dataType.simpleString()
    pages = cut_lineage(page_table(df, key))
    grams = vocabulary(pages)
    right = corrections(grams)
    titled = pages.join(recurring_lines(pages, key_type), "_key", "left").join(broken_words(pages, grams, key_type), "_key", "left")
    titled = cut_lineage(titled)
    model = line_model(titled.select("_page", "_text", "_titles"))
    arrow = pa.int64() if key_type == "bigint" else pa.string()
    out = (f"{key} {key_type}, text string, noise array<string>", [key, "text", "noise"], [arrow, pa.string(), pa.list_(pa.string())])

    forms = right.limit(BROADCAST_FORMS + 1).collect()
    if len(forms) <= BROADCAST_FORMS:  # a vocabulary of proven size
        shared = df.sparkSession.sparkContext.broadcast(Corrections({r[0]: r[1] for r in forms}))

        def known(row: dict) -> list[tuple]:
            return [(row["_key"], *repair(row["_text"], row["_page"], set(row["_titles"] or []), set(row["_breaks"] or []), shared.value, model))]

        return _map(titled, known, *out)

    def needed(row: dict) -> list[tuple]:
        lookups = Lookups()
        repair(row["_text"], row["_page"], set(row["_titles"] or []), set(row["_breaks"] or []), lookups, model)
        return [(row["_key"], g) for g in sorted(lookups.seen)]

    pairs = _map(titled, needed, f"_key {key_type}, _gram string", ["_key", "_gram"], [arrow, pa.string()])
    own = pairs.join(right, "_gram").groupBy("_key").agg(F.collect_list(F.struct("_gram", "_right")).alias("_forms"))

    def joined(row: dict) -> list[tuple]:
        forms = Corrections({x["_gram"]: x["_right"] for x in row["_forms"] or []})
        return [(row["_key"], *repair(row["_text"], row["_page"], set(row["_titles"] or []), set(row["_breaks"] or []), forms, model))]

    return _map(titled.join(own, "_key", "left"), joined, *out)


def page_noise(df: DataFrame, key: str = "row_id") -> DataFrame:
    """(key, noise): one row for each kind of noise on a scanned page."""
    return repaired_pages(df, key).select(key, F.explode(F.array_distinct("noise")).alias("noise"))
