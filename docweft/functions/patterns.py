"""Patterns that find identities, contacts, measurements and certificates, and the keys facts are compared by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweft.functions.text import SPACE, normalize_text

W = r"[\p{L}\p{N}_]"  # a word character of any script

# What each signal looks like. Bounds use any script's letters, so an address glued to Han text is none.
EMAIL = rf"(?<![\p{{L}}\p{{N}}_.+-])[A-Za-z0-9.!#$%&'*+/=?^_`{{|}}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]{{0,61}}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{{0,61}}[A-Za-z0-9])?)+(?![\p{{L}}\p{{N}}_-])"
URL = r"(?i)(?<![\p{L}\p{N}_])(?:https?://|www\.)[^\s<>\[\]{}\"'，。；、]+"
DOMAIN = r"(?i)(?<![@\p{L}\p{N}_-])(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+(?:com|cn|net|org|gov|edu|io|co|biz|info|tech|ai|xyz|top|shop|site)(?![\p{L}\p{N}_-])"
MOBILE = r"(?<!\d)(?:\+?86[-\s]?)?1[3-9]\d{9}(?!\d)"
LABELLED_PHONE = r"(?i)(?:电话|手机|热线|传真|tel(?:ephone)?|phone|fax)\s*[:：]?\s*((?:\+?86[-\s]?)?(?:0\d{2,3}[-\s]?)?\d{7,11}(?:[-转]\d{1,6})?)"
ORGANISATION = r"[\x{4e00}-\x{9fff}A-Za-z0-9（）()·&]{2,40}?(?:股份有限公司|有限责任公司|有限公司|集团有限公司|集团|研究院|研究所)"
SIGNALS = (("email", EMAIL, 0), ("url", URL, 0), ("domain", DOMAIN, 0), ("phone", MOBILE, 0), ("phone", LABELLED_PHONE, 1), ("organization_name", ORGANISATION, 0))
TRAILING = ".,;:!?，。；：！？、)"
QR_MARKERS = ("二维码", "qr code", "qrcode", "qr-code", "qr_code")

MODEL = r"(?<![A-Za-z0-9])(?=[A-Za-z0-9-]*\d)[A-Za-z][A-Za-z0-9]*(?:-[A-Za-z0-9]+)*(?![A-Za-z0-9])"
UNITS = "mm|cm|km|m|μm|um|nm|kg|mg|μg|ug|g|kV|mV|V|mA|A|kW|mW|W|MHz|kHz|Hz|MPa|kPa|Pa|ms|s|℃|°C|%|dB|分钟|小时|秒|年|页|个|套|次|倍|像素|英寸|道|级"
NUMBER_UNIT = rf"(?i)(?<![\p{{L}}\p{{N}}_.])(?:\d+(?:\.\d+)?(?:\s*[-~至]\s*\d+(?:\.\d+)?)?)\s*(?:{UNITS})(?![A-Za-z])"
CERTIFICATION = r"(?i)(?<![A-Za-z0-9])(?:(?:ISO|IEC)\s*[-/]?\s*\d{3,6}|CE|FDA|CCC|CNAS|CMA)(?![A-Za-z0-9])|认证|资质|证书|注册证|备案|检测机构|检测报告|合格证|许可证|专利|符合"
PLACEHOLDER_SLOT = r"(?i)X{2,}|[ＸＸ]{2,}|产品全称|产品型号|型号|待填|请输入"
PLACEHOLDERS = ("XXX", "XX", "待核实", "TBD", "TODO", "请输入", "此处文件为产品示例图片")


def signal_values(text: Column, pattern: str, group: int = 0) -> Column:
    """All non-empty matches, without closing punctuation at their ends."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.filter(F.transform(found, lambda v: F.regexp_replace(v, r"[.,;:!?，。；：！？、)]+$", "")), lambda v: v != "")


FACT_KINDS = ("model", "number_unit", "certification")


def fact_tokens(text: Column, kinds: tuple[str, ...] = FACT_KINDS) -> Column:
    """Array of (kind, token) of the facts in a text; only the patterns of ``kinds`` run."""

    def tagged(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("token")))

    found = {"model": lambda: F.filter(tagged("model", MODEL), lambda x: ~F.upper(x["token"]).startswith("ISO") & ~F.upper(x["token"]).startswith("IEC")), "number_unit": lambda: tagged("number_unit", NUMBER_UNIT), "certification": lambda: tagged("certification", CERTIFICATION)}
    return F.concat(*(found[kind]() for kind in FACT_KINDS if kind in kinds))


def fact_key(kind: Column, token: Column) -> Column:
    """What two notations of one fact have in common: case, spaces, the degree sign, decimal commas, and for model
    numbers the characters that recognition confuses."""
    value = F.regexp_replace(F.upper(normalize_text(token)), f"{SPACE}+", "")
    number = F.regexp_replace(F.replace(value, F.lit("℃"), F.lit("°C")), r"(?<=\d)[,，．](?=\d)", ".")
    return F.when(kind == "model", F.translate(value, "ILOQSB", "110058")).when(kind == "number_unit", number).otherwise(value)


def target_host(target: Column) -> Column:
    """Host of a relationship's target in lower case: the part behind @ of a mail address, empty if there is none."""
    target = F.trim(F.coalesce(target, F.lit("")))
    mail = F.regexp_extract(F.lower(target), r"^mailto:[^?]*@([^@?]+)", 1)
    host = F.regexp_extract(F.lower(target), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:@]*)", 1)
    bare = F.regexp_extract(F.lower(target), r"^(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.when(F.lower(target).startswith("mailto:"), mail).when(target.contains("://") | target.startswith("//"), host).otherwise(bare)


def is_external(target: Column, mode: Column) -> Column:
    """Whether a relationship leaves its package."""
    scheme = F.lower(F.coalesce(target, F.lit(""))).rlike(r"^(?:[a-z][a-z0-9+.-]*://[^/]|mailto:|file:)")
    return (F.lower(F.coalesce(mode, F.lit(""))) == "external") | scheme


def term_domain(term: Column) -> Column:
    """Domain that an identity term names, empty if none."""
    term = F.lower(F.trim(F.coalesce(term, F.lit(""))))
    mail = F.when(term.contains("@"), F.substring_index(term, "@", -1)).otherwise(term)
    host = F.when(mail.contains("://"), F.regexp_extract(mail, r"://(?:[^/@]*@)?([^/:?#]*)", 1)).otherwise(mail)
    host = F.regexp_replace(host, r"^[./ ]+|[./ ]+$", "")
    return F.when(host.rlike(r"^(?:[a-z0-9-]+\.)+[a-z]{2,}$"), host).otherwise("")


def occurrences(text: Column, term: Column) -> Column:
    """How often a term occurs, case aside, without overlaps; 0 for an empty term."""
    low, find = F.lower(F.coalesce(text, F.lit(""))), F.lower(F.coalesce(term, F.lit("")))
    gone = F.length(low) - F.length(F.replace(low, find, F.lit("")))
    return F.when(F.length(find) == 0, F.lit(0)).otherwise((gone / F.length(find)).cast("int"))


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.coalesce(text, F.lit("")).contains(word)
    return found
