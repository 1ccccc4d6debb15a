"""Problem 2: spellings of one organisation or person, linked.

Each different spelling is read into a core (the brand, or the family name) and what stands around it. Cores that
differ by a slip are found by MinHash banding over their padded q-grams; the numbers of rows and bands follow from
the collision curve 1 - (1 - s^rows)^bands. Whether two spellings fit is decided by Monge-Elkan similarity over their
other words, which also knows abbreviations, initials and nicknames. Star clustering joins them: the fullest and most
frequent spellings are centres, every other spelling goes to the one centre it fits best, or to none if several fit.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweft.llm.names import FAMILY, FAMILY_TWO, SHORT_FORMS, TITLES_ZH
from docweft.session import cut_lineage

ORG_LABELS = ("制造商", "生产厂家", "供应商", "Manufacturer", "Made by", "Supplier")
PERSON_LABELS = ("编制", "审核", "Prepared by", "Checked by")
#: Terms that name nobody (fixed values).
NOBODY = r"(?i)^[\s\p{P}]*(?:n/?a|n\.a\.|none|nil|null|unknown|unnamed|anonymous|tb[dca]|to be (?:confirmed|determined|defined|named|supplied)|not (?:known|available|applicable|specified|stated|given)|see .*|as (?:stated|shown|given|per|above|on)\b.*|same as above|various|other|无|暂无|没有|未知|不详|未注明|未标注|未提供|待定|待确认|待补充?|待填|待查|同上|其他|其它|见.*|详见.*|按(?:铭牌|封面|合同|图纸).*|以(?:铭牌|封面).*)?[\s\p{P}]*$"

# Words that many firms carry in their names, and the forms of companies.
GENERIC = set(
    "engineering packaging controls control manufacturing equipment technology technologies systems system automation precision instruments instrument flow industries industry industrial electronics electric electrical electronic mechanical machinery machines "
    "machine tools tool hydraulics pneumatics robotics sensors sensing measurement metering process processing products solutions services service group holding holdings international global trading components materials plastics metals chemicals chemical energy "
    "power pumps valves drives motion logistics laboratories labs research design works factory plant the of and for scientific optical optics digital data software hardware networks communications laser thermal water air gas marine aerospace automotive medical".split()
)
LEGAL = {
    "ltd": "ltd", "limited": "ltd", "coltd": "ltd", "companylimited": "ltd", "plc": "ltd", "llc": "llc", "inc": "inc", "incorporated": "inc", "corp": "corp", "corporation": "corp", "gmbh": "gmbh", "gesellschaftmbh": "gmbh",
    "gesellschaftmitbeschrankterhaftung": "gmbh", "ag": "ag", "sa": "sa", "srl": "srl", "spa": "spa", "bv": "bv", "nv": "nv", "kg": "kg", "oy": "oy", "ab": "ab", "as": "as", "co": "", "company": "", "mbh": "gmbh", "gesellschaft": "",
}
ZH_WORDS = "流体 设备 智能 装备 精密 仪器 仪表 光电 科技 传感 技术 电气 电器 电子 制造 包装 机械 自动化 自动 阀门 测控 系统 机电 工业 实业 贸易 工程 材料 动力 能源 液压 气动 环保 生物 医疗 信息 软件 网络 通信 通讯 控制 检测 测量 机器人 数控 模具 五金 化工 重工 电力 电机 泵业 轴承 轨道 汽车 航空 船舶 食品 印刷 激光 真空 制冷 水务 物流".split()
ZH_LEGAL = ("集团股份有限公司", "股份有限公司", "集团有限公司", "有限责任公司", "有限公司", "股份公司", "责任公司", "集团公司", "总公司", "分公司", "公司", "集团", "总厂", "厂", "厂家", "商行", "事务所", "研究所", "研究院")
#: MinHash: rows and bands for cores of at least five letters, and for short Chinese cores. A slip in a core of ten
#: letters leaves a similarity of about 0.5: found with 0.9997; unrelated cores (0.05) meet in 0.8 % of cases. A wrong
#: character in a Chinese brand of three leaves 0.4, found with 0.998.
LATIN, HAN = (3, 60), (2, 36)
#: Least Monge-Elkan similarity of words that have to fit.
FITS = 0.85
#: Shorter cores are too short for q-grams to tell a slip from another name; they meet by what one deletion leaves.
SHORT_LATIN, SHORT_HAN = 5, 3


def collision(similarity: float, rows: int, bands: int) -> float:
    """Probability that two cores of that q-gram similarity meet in at least one band."""
    return 1 - (1 - similarity**rows) ** bands


def spellings(terms: DataFrame, texts: DataFrame) -> DataFrame:
    """(name, person, weight) of each different spelling: elements of ``manufacturer_terms`` and labelled lines of ``text``.

    Null, blank and nobody's names are left out. A name on a person's line and among organisations is two spellings.
    """
    named = terms.select(F.explode("manufacturer_terms").alias("name"), F.lit(False).alias("person"))
    label = rf"^({'|'.join(ORG_LABELS + PERSON_LABELS)})(?:：|: )(.*)$"
    lines = texts.where(F.col("text").rlike("(?m)" + label)).select(F.explode(F.split("text", r"\r?\n|\r")).alias("line")).where(F.col("line").rlike(label))
    lined = lines.select(F.regexp_extract("line", label, 2).alias("name"), F.regexp_extract("line", label, 1).isin(*PERSON_LABELS).alias("person"))
    rows = named.where("name IS NOT NULL").unionByName(lined).groupBy("name", "person").agg(F.count("*").alias("weight"))
    return rows.where(~F.col("name").rlike(NOBODY))


def with_places(names: DataFrame) -> DataFrame:
    """``names`` with ``places``: those of all known places that a Chinese organisation's name holds.

    A place is known where it stands before 市 or 省 at the start of names, or in brackets in them, at least twice. Names and
    places meet in a join on the name's parts of two to four characters, so their number doesn't matter.
    """
    rows = names.where("NOT person").select("name", F.translate(F.regexp_replace("name", r"\s", ""), _OLD + "（）", _NEW + "()").alias("_bare")).where(F.col("_bare").rlike(r"[\x{4e00}-\x{9fff}]{2}"))
    found = F.array(F.regexp_extract("_bare", r"^([\x{4e00}-\x{9fff}]{2,4}?)(?:市|省)", 1), F.regexp_extract("_bare", r"\(([\x{4e00}-\x{9fff}]{2,4})\)", 1))
    known = rows.select("_bare", F.explode(found).alias("_place")).where("_place <> ''").distinct().groupBy("_place").agg(F.count("*").alias("_n"))
    known = known.where(~F.col("_place").isin("股份", "集团", "有限", "责任", "中国") & (F.col("_n") >= 2)).select("_place")
    parts = F.flatten(F.transform(F.sequence(F.lit(2), F.lit(4)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("_bare") - n + 1, F.lit(1))), lambda i: F.substring(F.col("_bare"), i, n))))
    held = rows.select("name", F.explode(F.array_distinct(parts)).alias("_place")).join(known, "_place").groupBy("name").agg(F.collect_set("_place").alias("places"))
    return names.join(held.withColumn("person", F.lit(False)), ["name", "person"], "left")


# Traditional characters and, in the same places, their simplified forms.
_OLD = "設備儀錶電氣機裝術傳動統測業廠網訊資產貿運輸軟環實務東華國際興龍馬門閥鋼鐵銅鋁錫飛車農藥醫療學劃製濾壓熱廣陽寧濱瀾嶺張臨滄嶼鳴綏數碼導紅島橋灣澤鵬輝潤聯達發長順遠開關總責團無錦銳寶豐億萬騰創鴻偉賢頂願櫟驍駿陸傑觀鎮節體貝見貢財貨質購賽贏趙跡軌輪轉農遲選邁郵鄭醬釋針釘鉗鉚鉛鍋鍛鏈鏡鑄鑽閃閉問間隊階陰險隨隱雙雜離難電靈靜頁項須預領頭題額風餐飯飲館駕驗鬆魚鳥麥黃點齊齒械"
_NEW = "设备仪表电气机装术传动统测业厂网讯资产贸运输软环实务东华国际兴龙马门阀钢铁铜铝锡飞车农药医疗学划制滤压热广阳宁滨澜岭张临沧屿鸣绥数码导红岛桥湾泽鹏辉润联达发长顺远开关总责团无锦锐宝丰亿万腾创鸿伟贤顶愿栎骁骏陆杰观镇节体贝见贡财货质购赛赢赵迹轨轮转农迟选迈邮郑酱释针钉钳铆铅锅锻链镜铸钻闪闭问间队阶阴险随隐双杂离难电灵静页项须预领头题额风餐饭饮馆驾验松鱼鸟麦黄点齐齿械"
SIMPLER = dict(zip(map(ord, _OLD), _NEW, strict=True))


def jaro_winkler(a: str, b: str) -> float:
    """Winkler's similarity of two words."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used, first = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                first.append(c)
                break
    if not first:
        return 0.0
    second = [c for c, u in zip(b, used, strict=True) if u]
    m, t = len(first), sum(x != y for x, y in zip(first, second, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    prefix = next((k for k, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro)


def one_slip(a: str, b: str) -> bool:
    """Whether one insertion, deletion, substitution or exchange of neighbours makes ``a`` to ``b``."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def word_similarity(a: str, b: str) -> float:
    """Similarity of two words of a name; ``x.`` is an initial or abbreviation."""
    if a == b:
        return 1.0
    short, long = sorted((a.rstrip("."), b.rstrip(".")), key=len)
    if not short:
        return 0.0
    if len(short) == 1:
        return 0.95 if long.startswith(short) and (a.endswith(".") or b.endswith(".") or len(a) == 1 or len(b) == 1) else 0.0
    if len(long) - len(short) >= 2 and short[0] == long[0] and len(short) <= 7:
        rest = iter(long)
        if all(c in rest for c in short):  # its letters in order
            return 0.95
    if one_slip(short, long) and len(long) > 3:
        return 0.93
    score = jaro_winkler(short, long)
    return score if score >= 0.92 else score * 0.8


def monge_elkan(a: list[str], b: list[str]) -> float:
    """Mean over the words of the shorter name of their best match in the other, each word of which serves once."""
    if len(a) > len(b):
        a, b = b, a
    left, total = list(b), 0.0
    for x in a:
        best = max(range(len(left)), key=lambda k: word_similarity(x, left[k]), default=None)
        if best is None:
            break
        total += word_similarity(x, left[best])
        left.pop(best)
    return total / len(a) if a else 1.0


def _is_generic(word: str) -> bool:
    bare = word.rstrip(".")
    if bare in GENERIC or bare in LEGAL:
        return True
    if word.endswith("."):  # an abbreviation of a generic word: its letters in order
        return any(g[0] == bare[:1] and len(g) > len(bare) + 1 and all(c in it for it in [iter(g)] for c in bare) for g in GENERIC)
    if len(bare) <= 5:  # without a dot its beginning, or its consonants
        return any(len(g) > len(bare) + 1 and ((len(bare) > 2 and g.startswith(bare)) or (not re.search("[aeiou]", bare[1:]) and g[0] == bare[:1] and all(c in it for it in [iter(g)] for c in bare))) for g in GENERIC)
    return any(one_slip(bare, g) for g in GENERIC if len(g) > 5 and abs(len(g) - len(bare)) < 2)


def read_org_latin(name: str) -> dict:
    text = unicodedata.normalize("NFKC", name).casefold().replace("&", " ").replace(" and ", " ")
    bracket = " ".join(re.findall(r"\(([^)]*)\)", text))
    text = re.sub(r"\([^)]*\)", " ", text)
    text = re.sub(r"\bco\.?,? ?ltd\b\.?|\bcompany limited\b", " coltd ", text)
    text = re.sub(r"\bgesellschaft mbh\b|\bg\.? ?m\.? ?b\.? ?h\b\.?", " gmbh ", text)
    legal, words = "", []
    parts = text.split(",")
    tail = [w for p in parts[1:] for w in re.findall(r"[^\W_]+(?:[.'-][^\W_]+)*\.?", p)]
    found = re.findall(r"[^\W_]+(?:[.'-][^\W_]+)*\.?", parts[0]) + tail
    for w in found:
        bare = w.replace(".", "")
        dotted = re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]?\.?", w)
        if bare in LEGAL and not (dotted and w is not found[-1]):  # initials may spell a legal form, but not inside
            legal = LEGAL[bare] or legal
        elif re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]?\.?", w):  # initials
            words += [f"{c}." for c in w if c.isalpha()]
        else:
            words.append(w)
    # the brand: the run of words that aren't generic; in brackets or behind a comma if there is none before
    own = [w for w in words if not _is_generic(w) and len(w.rstrip(".")) > 1]
    if not own:
        own = [w for w in re.findall(r"[^\W_]+(?:['-][^\W_]+)*", bracket) if not _is_generic(w)]
    brand = re.sub(r"[^\w]", "", "".join(own))
    return {"core": brand, "words": [w for w in words if w not in own], "legal": legal, "place": "", "script": "latin"}


def read_org_han(name: str, known: set[str]) -> dict:
    text = re.sub(r"[\s·.,，。、&-]", "", unicodedata.normalize("NFKC", name)).translate(SIMPLER)
    place = ""
    for m in re.findall(r"\(([^)]*)\)", text):
        if m in known and not place:
            place = m
        elif m not in known:
            text = text.replace(f"({m})", m)
    text = re.sub(r"\([^)]*\)", "", text)
    legal = next((x for x in ZH_LEGAL if text.endswith(x)), "")
    text = text[: len(text) - len(legal)]
    if not place:
        m = re.match(r"([一-鿿]{2,4}?)市", text)
        if m:
            place, text = m[1], text[m.end() :]
        else:
            for size in (4, 3, 2):
                at = next((i for i in range(len(text) - size + 1) if text[i : i + size] in known and (i == 0 or i >= 2)), -1)
                if at >= 0:
                    place, text = text[at : at + size], text[:at] + text[at + size :]
                    break
    # the business: generic words from the end, the last of them maybe cut short
    end = len(text)
    while end > 2:
        size = next((len(w) for w in ZH_WORDS if text[:end].endswith(w) and end - len(w) >= 2), 0)
        if not size:
            break
        end -= size
    if end == len(text):
        for cut in (1, 2):
            head = text[: len(text) - cut]
            part = text[len(text) - cut :]
            whole = next((w for w in ZH_WORDS if head.endswith(w) and len(head) - len(w) >= 2), "")
            if whole or (cut == 1 and len(text) == 4 and any(w.startswith(part) for w in ZH_WORDS)):
                end = len(head)
                while end > 2 and (size := next((len(w) for w in ZH_WORDS if text[:end].endswith(w) and end - len(w) >= 2), 0)):
                    end -= size
                break
    return {"core": text[:end], "words": [text[end:]] if text[end:] else [], "legal": legal, "place": place, "script": "han"}


def read_person(name: str) -> dict:
    text = unicodedata.normalize("NFKC", name).strip()
    if re.search(r"[一-鿿]", text):
        text = re.sub(rf"(?:\s*(?:{TITLES_ZH}))+$", "", text)
        parts = text.split()
        bare = "".join(parts)
        if len(parts) == 2 and len(parts[1]) <= 2 and (parts[1] in FAMILY or parts[1] in FAMILY_TWO) and (len(parts[0]) > 1 or parts[0] not in FAMILY):
            bare = parts[1] + parts[0]
        return {"core": bare, "words": [], "legal": "", "place": "", "script": "han"}
    text = re.sub(r"^(?:mr|mrs|ms|miss|dr|prof|eng|ing|sir)\b\.?\s+", "", text, flags=re.I)
    if "," in text:
        family, _, given = text.partition(",")
    else:
        parts = text.split()
        capital = [p for p in parts if len(p) > 2 and p.isupper()]
        if capital and len(capital) < len(parts):
            family, given = " ".join(capital), " ".join(p for p in parts if p not in capital)
        else:
            family, given = (parts or [""])[-1], " ".join(parts[:-1])
    given = [w.casefold() for w in re.findall(r"[^\W\d_]+\.?", given)]
    return {"core": re.sub(r"\W", "", family.casefold()), "words": given[:1] if given else [], "legal": "", "place": "", "script": "latin"}


def read(name: str, person: bool, known: set[str]) -> dict:
    """The core of a spelling and what stands around it."""
    if person:
        return read_person(name)
    return read_org_han(name, known) if re.search(r"[一-鿿]", name) else read_org_latin(name)


@functools.lru_cache(maxsize=100_000)
def _known_given(word: str) -> str:
    """A given name one slip away from a single known one is taken for it."""
    if word in SHORT_FORMS or len(word.rstrip(".")) < 5:
        return word
    near = {n for n in SHORT_FORMS if len(n) > 4 and one_slip(word, n)}
    return near.pop() if len(near) == 1 else word


def _given_fits(a: list[str], b: list[str]) -> float:
    if not a or not b:
        return 0.9
    x, y = _known_given(a[0]), _known_given(b[0])
    if len(x.rstrip(".")) == 1 or len(y.rstrip(".")) == 1:
        short, long = sorted((x, y), key=len)
        return 0.9 if any(n[0] == short[0] for n in SHORT_FORMS.get(long, set()) | {long}) else 0.0
    if SHORT_FORMS.get(x, {x}) & SHORT_FORMS.get(y, {y}):
        return 0.97
    if x in SHORT_FORMS and y in SHORT_FORMS:
        return 0.0
    return word_similarity(x, y)


def fits(a: dict, b: dict, person: bool) -> float:
    """Similarity of two spellings with the same core, 0 if something contradicts."""
    if person:
        score = _given_fits(a["words"], b["words"])
        return score if score >= FITS else 0.0
    if a["script"] != b["script"]:
        return 0.0
    if a["script"] == "han":
        if a["place"] and b["place"] and a["place"] != b["place"]:
            return 0.0
        x, y = "".join(a["words"]), "".join(b["words"])
        if x and y:
            short, long = sorted((x, y), key=len)
            rest = iter(long)
            if not (one_slip(x, y) or (len(short) < len(long) and all(c in rest for c in short))):
                return 0.0
        return (1 + (x == y and bool(x)) + (bool(a["place"]) and a["place"] == b["place"]) + (bool(a["legal"]) and a["legal"] == b["legal"]) * 0.5) / 3.5
    if a["legal"] and b["legal"] and a["legal"] != b["legal"]:
        return 0.0
    if a["words"] and b["words"]:
        score = monge_elkan(a["words"], b["words"])
        in_order = all(word_similarity(x, y) >= FITS for x, y in zip(a["words"], b["words"], strict=False))
        return score + 0.02 * in_order if score >= FITS else 0.0
    return 0.5 + 0.3 * (bool(a["legal"]) and a["legal"] == b["legal"])


def fullness(x: dict, person: bool) -> int:
    """How much of a name a spelling spells out."""
    if person:
        return sum(2 if len(w.rstrip(".")) > 1 else 1 for w in x["words"]) + any(w in SHORT_FORMS and w in SHORT_FORMS[w] for w in x["words"])
    if x["script"] == "han":
        return 2 * bool(x["place"]) + len("".join(x["words"])) + len(x["legal"])
    return sum(len(w.rstrip(".")) > 1 for w in x["words"]) * 2 + sum(not w.endswith(".") for w in x["words"]) + bool(x["legal"])


def star_clusters(names: list[tuple[str, int, dict]], person: bool) -> list[tuple[str, str, int]]:
    """(name, centre, weight of the centre's cluster) of the forms of one core, given as (name, weight, what it reads)."""
    seen = list(names)
    seen.sort(key=lambda x: (-fullness(x[2], person), -x[1], x[0]))
    centres: list[tuple[str, dict]] = []
    of: dict[str, str] = {}
    loose = []
    for name, _, x in seen:
        scored = sorted(((fits(x, c, person), n) for n, c in centres), reverse=True)
        scored = [s for s in scored if s[0] > 0]
        if not scored:
            centres.append((name, x))
            of[name] = name
        elif len(scored) == 1 or scored[0][0] > scored[1][0] + 1e-9:
            of[name] = scored[0][1]
        else:
            loose.append(name)  # it fits several entities alike
    for name in loose:
        of[name] = name
    weight: dict[str, int] = {}
    for name, w, _ in seen:
        weight[of[name]] = weight.get(of[name], 0) + w
    return [(name, of[name], weight[of[name]]) for name, _, _ in seen]


def signature(core: str, rows: int, bands: int) -> list[int]:
    """Band hashes of a core's padded q-grams (characters too, where the core is short)."""
    padded = f"^{core}$"
    grams = {padded[i : i + 2] for i in range(len(padded) - 1)}
    if len(core) <= 4:
        grams |= set(core)
    codes = np.array([zlib.crc32(g.encode()) for g in grams], np.uint64)[:, None]
    k = np.arange(1, rows * bands + 1, dtype=np.uint64)
    mixed = (codes * (k * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1))) ^ (k * np.uint64(0xC2B2AE3D27D4EB4F))
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    least = mixed.min(axis=0).reshape(bands, rows)
    out = np.zeros(bands, np.uint64)
    for r in range(rows):
        out = (out * np.uint64(0x100000001B3)) ^ least[:, r]
    out = out * np.uint64(131) + np.arange(bands, dtype=np.uint64)
    return out.view(np.int64).tolist()


def deletions(core: str) -> list[int]:
    """Keys that a short core shares with every core one slip away: itself, and what is left without one character."""
    left = {core} | {core[:i] + core[i + 1 :] for i in range(len(core))} if len(core) > 1 else {core}
    return [zlib.crc32(x.encode()) | 1 << 40 for x in sorted(left) if x]


def close_cores(cores: DataFrame) -> DataFrame:
    """(person, core, other): different cores one slip apart, found in a common band; both directions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands = []
            for core in batch.column(1).to_pylist():
                han = bool(re.search(r"[一-鿿]", core))
                bands.append(signature(core, *(HAN if han else LATIN)) if len(core) >= (SHORT_HAN if han else SHORT_LATIN) else deletions(core))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bands, pa.list_(pa.int64()))], names=["person", "core", "bands"])

    banded = cores.select("person", "core").mapInArrow(run, "person boolean, core string, bands array<bigint>").select("person", "core", F.explode("bands").alias("band"))
    banded = cut_lineage(banded)
    a, b = banded.alias("a"), banded.alias("b")
    # cores are different strings, so a band holds no copies; what meets by chance is dropped by the distance at once
    near = F.levenshtein(F.col("a.core"), F.col("b.core"))
    swapped = F.array_join(F.array_sort(F.split("a.core", "")), "") == F.array_join(F.array_sort(F.split("b.core", "")), "")
    met = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.person") == F.col("b.person")) & (F.col("a.core") < F.col("b.core")) & (F.abs(F.length("a.core") - F.length("b.core")) <= 1))
    met = met.where((near <= 1) | ((near == 2) & swapped)).select(F.col("a.person").alias("person"), F.col("a.core").alias("core"), F.col("b.core").alias("other")).distinct()
    return met.unionByName(met.select("person", F.col("other").alias("core"), F.col("core").alias("other")))


def link_variants(names: DataFrame) -> DataFrame:
    """(name, person, entity, weight): each spelling with its entity's central spelling. Entities are linked within
    organisations and within persons. ``names`` is what ``spellings`` gives; an empty table gives an empty one."""
    names = cut_lineage(with_places(names))

    def cores_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = [read(r["name"], r["person"], set(r["places"] or ())) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f["core"] for f in forms], pa.string()), pa.array([repr(f) for f in forms], pa.string())], names=["name", "person", "weight", "places", "core", "form"])

    types = "name string, person boolean, weight bigint, places array<string>, core string, form string"
    parsed = cut_lineage(names.select("name", "person", "weight", "places").mapInArrow(cores_of, types))
    # spellings that read alike are one form; a core's forms are different strings, a few for each firm or family
    forms = parsed.groupBy("person", "core", "form").agg(F.max(F.struct("weight", "name", "places")).alias("best"), F.sum("weight").alias("weight"))
    grouped = forms.groupBy("person", "core").agg(F.collect_list(F.struct(F.col("best.name").alias("name"), "weight", F.col("best.places").alias("places"))).alias("names"))

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                held = {x["name"]: x["places"] or [] for x in row["names"]}
                pairs = [(x["name"], x["weight"], read(x["name"], row["person"], set(held[x["name"]]))) for x in row["names"]]
                if row["core"]:
                    found = star_clusters(pairs, row["person"])
                else:  # nothing but generic words: each is on its own
                    found = [(n, n, w) for n, w, _ in pairs]
                out += [(n, row["person"], row["core"], c, held[c], w) for n, c, w in found]
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int64()), strict=True)], names=["best", "person", "core", "entity", "places", "weight"])

    starred = cut_lineage(grouped.mapInArrow(stars, "best string, person boolean, core string, entity string, places array<string>, weight bigint"))
    of_form = forms.select("person", "core", "form", F.col("best.name").alias("best"))
    linked = parsed.select("name", "person", "core", "form").join(of_form, ["person", "core", "form"]).join(starred, ["person", "core", "best"])
    linked = cut_lineage(linked.select("name", "person", "core", "entity", "places", "weight"))
    entities = linked.select("person", "core", "entity", "places", "weight").distinct()
    # entities of cores one slip apart: the lighter may be a misspelling of the heavier
    other = entities.select("person", F.col("core").alias("other"), F.col("entity").alias("to"), F.col("places").alias("to_places"), F.col("weight").alias("to_weight"))
    heavier = (F.col("to_weight") > F.col("weight")) | ((F.col("to_weight") == F.col("weight")) & (F.col("to") < F.col("entity")))
    tried = entities.join(close_cores(entities.select("person", "core").where("core <> ''").distinct()), ["person", "core"]).join(other, ["person", "other"]).where(heavier)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                a, b = read(row["entity"], row["person"], set(row["places"] or ())), read(row["to"], row["person"], set(row["to_places"] or ()))
                score = fits(a, b, row["person"])
                if row["person"]:
                    sure = a["script"] == "latin" and bool(a["words"]) and bool(b["words"])
                elif a["script"] == "han":
                    sure = bool(a["words"]) and a["words"] == b["words"] and bool(a["place"]) and a["place"] == b["place"]
                else:
                    sure = bool(a["words"]) and bool(b["words"]) or (a["legal"] == b["legal"] and 3 * row["weight"] <= row["to_weight"])
                if len(a["core"]) < SHORT_LATIN and a["script"] == "latin":  # a slip in a short name often makes another name
                    sure = sure and 3 * row["weight"] <= row["to_weight"]
                if score > 0 and sure:
                    out.append((row["person"], row["entity"], row["to"], score, row["to_weight"]))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.bool_(), pa.string(), pa.string(), pa.float64(), pa.int64()), strict=True)], names=["person", "entity", "to", "score", "to_weight"])

    moves = tried.select("person", "entity", "places", "weight", "to", "to_places", "to_weight").mapInArrow(judged, "person boolean, entity string, to string, score double, to_weight bigint")
    moves = moves.groupBy("person", "entity").agg(F.max_by("to", F.struct("score", "to_weight", "to")).alias("to"))
    moves = cut_lineage(moves)
    # a centre that itself moves hands its spellings on, each step to a heavier one: the hops double until none is left
    while True:
        onward = moves.select("person", F.col("entity").alias("to"), F.col("to").alias("onward"))
        hopped = moves.join(onward, ["person", "to"], "left")
        if hopped.where("onward IS NOT NULL").isEmpty():
            break
        moves = cut_lineage(hopped.select("person", "entity", F.coalesce("onward", "to").alias("to")))
    return linked.join(moves, ["person", "entity"], "left").select("name", "person", F.coalesce("to", "entity").alias("entity"), "weight")


def variant_pairs(linked: DataFrame) -> DataFrame:
    """(name_a, name_b) of every two different spellings of one entity, the smaller by code points first."""
    rows = cut_lineage(linked.select("name", "person", "entity"))
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.person") == F.col("b.person")) & (F.col("a.entity") == F.col("b.entity")) & (F.col("a.name") < F.col("b.name")))
    return pairs.select(F.col("a.name").alias("name_a"), F.col("b.name").alias("name_b")).distinct()
