"""Problem 3: leftovers of templates, filler, error pages and script notices in place of content.

Texts are cut into segments (lines, and the parts of a shape's description). Marks of variables, defaults and blanks are
only candidates for slots: records of the same template are aligned on what stands around the mark, and what varies
between them is a slot. A mark is flagged where that alignment shows it to stand in one: the slot holds several
different fillings (of marks, or of ordinary values in other records of the label), the mark's name stands in the slots of
several templates or in several styles of marks, or the style of the mark wraps several names. Names induced that way
are also found where they stand in a filled slot without any mark.

Filler words are induced from segments without any function word. Messages are flagged if they recur over documents: those worded
like one by their frame (beginning and end, the middle is a slot), others with warning vocabulary word by word, while
no slot of theirs varies, which sentences about a product do.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.session import cut_lineage

KINDS = ("text", "shape_description")
#: Documents in which a message must recur, fillings that a slot must show, templates and names that a mark must.
RECURS = 3
#: Longer segments are no lines but pages on one line; those are read by sentences.
LINE = 400

# Marks that templates use: variables, defaults to be replaced, blanks. A prior only: none is flagged by itself.
MARKS = "|".join(
    (
        r"\{\{[^{}\n]{0,60}\}\}", r"\$\{[^{}\n]{1,60}\}", r"<%=?[^%\n]{0,60}%>", r"\[\[[^\[\]\n]{1,40}\]\]", r"@@[^@\s]{1,40}@@", r"(?<![\w%])%[A-Z][A-Z_]{2,30}%",
        r"(?i:\[\s*(?:insert|enter|add|type|your|please)\b[^\]\n]{0,60}\])", r"(?i:<[^<>\n]{1,60} to be (?:supplied|confirmed|added|defined|filled|completed)[^<>\n]{0,20}>)",
        r"[<＜\[［【(（]\s*(?:在此|此处|请在此|待填|待补|待定|请填|请输入|请录入|填写)[^<>＜＞\[\]［］【】()（）\n]{0,40}[\]］】)）>＞]",
        r"_{4,}", r"[\[［][ \t\x{3000}]+[\]］]", r"(?<![A-Za-z0-9_])X{4,}(?:-X{2,})*(?![A-Za-z0-9_])", r"#(?:REF!|N/A|VALUE!|NAME\?|DIV/0!|NULL!|引用!)", r"(?<![A-Za-z0-9_])(?:TBD|TBC|TODO|FIXME)(?![A-Za-z0-9_])",
    )
)
# Marks that plain text uses, too; these need a name that is known from elsewhere.
UNSURE = r"«[^»\n]{1,40}»|#[^#\s]{1,24}#|(?<![\w{$])\{\d{1,2}\}(?![\w}])|(?<![\w])X{2,3}(?:-X{1,3})*(?![\w])|‹[^›\n]{1,40}›"

# What a message says. Each stands for the whole segment or its beginning, so that sentences about errors don't fit.
UNANCHORED = r"(?i:.*\b(?:delete|remove|replace) (?:this |it )?(?:in|before) (?:the )?(?:final|release|publication|delivery).*)"
FILLER_BEGINS = "|".join(
    (
        r"(?i:(?:sample|dummy|placeholder|filler) (?:text|paragraph|content)\b.*)", r"(?i:placeholder for .*)", r"(?i:lorem ipsum\b.*)",
        r"(?i:click (?:here |icon )?to (?:edit|add|insert)\b.*)", r"(?i:(?:type|enter|insert|write|put) (?:the |your |a )[\w ]{1,40} (?:in|into) this (?:box|field|space).*)", r"(?i:your [\w ]{1,30} (?:goes )?here\W*)", r"(?i:[\w ]{1,40} goes here\W*)",
        r"(?i:(?:first|second|third|fourth|fifth) level)", r"第[一二三四五六]级", r"单击(?:此处|这里|以)(?:编辑|添加|输入).*", r"点击(?:此处|这里)(?:编辑|添加|输入).*", r"请?在?(?:此处|这里|此)为?占位.*", r"(?:此处|这里)(?:为|是)占位.*", r"请在(?:这里|此处|此)(?:添加|输入|填写|插入).*",
        r"(?:示例文字|示例文本|占位文字|占位符|文本文本|样例文字).{0,60}", r"[（(【\[]?(?:样板|样例|示例|占位|填充)(?:段落|文字|内容|文本)[，,。）)：:].{0,60}", r"[（(【\[].{0,20}(?:定稿|发布|交付|出版)前(?:请)?(?:删除|替换|移除).{0,20}", r"(.{2,12}?)\1{2,}",
    )
)
FILLER = f"{FILLER_BEGINS}|{UNANCHORED}"
ERRORS = "|".join(
    (
        r"(?i:error[!:]\s.*(?:not|undefined|invalid|missing|could|found|unknown).*)", r"(?:错误|出错)[!！:：].*", r"(?i:(?:internal|server|application|unexpected|unknown|fatal|runtime) (?:server )?error\b.{0,60})",
        r"(?i:[45]\d\d\s*[-–—:：]?\s*(?:the |your |您|page|not found|forbidden|error|bad|service|internal|gateway|unauthori[sz]ed|请求|页面|无权|服务).{0,80})", r"(?i:(?:http )?error [45]\d\d\b.{0,60})", r"(?i:bad gateway\b.{0,40}|gateway time-?out.{0,40}|upstream did not answer)",
        r"(?i:(?:the )?(?:service|server|system|site|page)(?: is)?(?: temporarily)? (?:busy|unavailable|down|offline|overloaded)\b.{0,80})", r"(?i:(?:the )?(?:requested )?(?:page|file|document|resource)(?: you requested)? (?:was not found|could not be (?:found|loaded|opened)|cannot be (?:found|displayed|opened|loaded)|does not exist|no longer exists)\b.{0,80})",
        r"(?i:access (?:is )?(?:denied|forbidden)\b.{0,80}|permission denied\b.{0,60}|you (?:are not allowed|do not have permission|don't have permission)\b.{0,80})", r"(?i:(?:your|the) session (?:has )?(?:ended|expired|timed out)\b.{0,80})", r"(?i:the linked (?:picture|image|file)\b.{0,100}|this (?:image|picture) (?:cannot|can't|could not) .{0,80})",
        r"(?i:(?:failed to load|loading failed|request failed|connection (?:refused|timed out|reset)|could not connect|something went wrong|oops)\b.{0,80})",
        r"(?:加载|载入|请求|连接|打开)(?:失败|超时|出错)[：:，,。!！]?.{0,40}", r"(?:服务器?|系统|网站)(?:正?繁忙|忙|不可用|错误|无响应|内部错误|异常).{0,40}", r"[45]\d\d\s*[-：:]?\s*(?:您|页面|请求|服务|无权|禁止).{0,40}", r"(?:会话|登录)(?:已|已经)?(?:过期|失效|超时|结束).{0,40}",
        r"无法(?:显示|打开|加载|找到)(?:该|此|链接|链接的|请求的)?(?:图片|图像|页面|文件|文档|网页).{0,40}", r"(?:您|你)?(?:无权|没有权限|暂无权限)(?:访问|打开|查看).{0,40}", r"(?:访问|请求)(?:被拒绝|受限|被禁止).{0,40}", r"(?:抱歉|对不起)[，,].{0,10}(?:页面|网页|文件|服务).{0,40}", r"(?:您)?(?:请求|访问|查找)的(?:页面|网页|文件).{0,6}(?:不存在|找不到|已被移除|已删除).{0,40}",
    )
)
SCRIPTS = "|".join(
    (
        r"(?i:(?:you need to|you must|please|to view this .{0,30}|we recommend)\W{0,3}(?:you )?(?:enable|turn on|switch on|activate|allow) (?:java\s?)?scripts?(?:ing)?\b.{0,80})", r"(?i:(?:java\s?)?scripts?(?:ing)? (?:is|are|must be|has been|have been|needs? to be) (?:blocked|disabled|turned off|switched off|required|enabled|needed|off)\b.{0,100})",
        r"(?i:(?:this|the) (?:\w+ )?(?:viewer|page|site|document|application|catalogue|manual|website)(?: viewer)? (?:needs|requires|uses|does not work without|works only with) (?:java\s?)?script(?:s|ing)?\b.{0,80})", r"(?i:(?:your )?browser (?:has|does not support|blocks|is blocking) (?:java\s?)?scripts?(?:ing)?\b.{0,80})", r"(?i:enable (?:java\s?)?scripts?\b.{0,60})", r"(?i:.{0,30}\benable javascript\b.{0,60})",
        r"(?:请|需要?|您需要)(?:先)?(?:启用|开启|打开|允许)(?:浏览器)?(?:的)?(?:java\s?script|脚本).{0,40}", r"(?i:请启用javascript.{0,40})", r"(?:当前|您的|本)?(?:浏览器|页面)(?:已|已经)?(?:禁用|关闭|阻止|不支持|拦截)(?:了)?(?:java\s?script|脚本).{0,40}", r"(?:本|该|此)?(?:文档|页面|网页|网站|查看器|文档查看器)(?:需要|必须|要求)(?:使用|启用|开启)?(?:java\s?script|脚本).{0,40}", r"检测到脚本.{0,40}", r"脚本(?:已|已被|被)(?:禁用|拦截|阻止|关闭).{0,40}",
    )
)
WARNING = (
    r"(?i:error|not found|denied|forbidden|unavailable|expired|timed out|failed|cannot be|could not be|sign in|log in|retry|refresh|reload|script|cookie|browser|server)"
    r"|错误|失败|无法|过期|拒绝|禁止|不存在|繁忙|超时|重试|刷新|重新加载|脚本|浏览器|登录|服务器"
)
FUNCTION_WORDS = r"(?i:\b(?:the|of|and|to|a|an|in|is|it|that|for|on|with|as|be|at|by|this|from|or|are|not|can|have|has|was|will|if|but|each|when|all|its|do|no|so|only|may|any|into|per|than|then|your|you|we|our|which|de|la|le|der|die|das|und|el|los|des|et|en)\b)"


# What any of the patterns above contains; an automaton finds them far cheaper than the patterns.
MARK_CUES = ("{", "[", "［", "【", "<", "＜", "@@", "__", "XX", "«", "‹", "#", "TBD", "TBC", "TODO", "FIXME", "在此", "此处", "待填", "待补", "待定", "请填", "请输入", "请录入", "填写")
MESSAGE_CUES = (
    "sample", "dummy", "placeholder", "filler", "delete in", "delete before", "delete this", "delete it", "remove in", "remove before", "remove this", "remove it", "replace in", "replace before", "replace this", "replace it", "lorem", "click", "this box", "this field", "this space",
    "goes here", "your ", "first level", "second level", "third level", "fourth level", "fifth level", "第一级", "第二级", "第三级", "第四级", "第五级", "第六级", "单击", "点击", "占位", "请在", "示例文", "示例段", "示例内", "样例", "样板段", "样板文", "样板内", "填充", "文本文本", "定稿前", "发布前", "交付前", "出版前",
    "error", "not found", "could not", "cannot", "can't", "busy", "unavailable", "denied", "forbidden", "permission", "not allowed", "session", "linked", "failed", "refused", "timed out", "connection reset", "went wrong", "oops", "bad gateway", "gateway time", "upstream", "unauthor", "offline", "overloaded", "down", "unexpected", "unknown", "can't", "moved", "server",
    "does not exist", "no longer exists", "you must", "错误", "出错", "加载", "载入", "失败", "超时", "繁忙", "系统忙", "服务忙", "网站忙", "不可用", "无响应", "异常", "过期", "失效", "结束", "无法", "无权", "没有权限", "暂无权限", "拒绝", "受限", "禁止", "抱歉", "对不起", "不存在", "找不到", "已被移除", "已删除", "您",
    "script", "脚本", "sign in", "log in", "retry", "refresh", "reload", "cookie", "browser", "expired", "重试", "刷新", "浏览器", "登录", "服务器",
)


_LEAD = r"(?m)(?:^|\| )(?:[^\S\n]|[•·*-])*"
BARE = re.compile(_LEAD + r"(?=[A-Za-z ,.;'\-]{24,}[^\S\n]*(?: \||$))(?!.*?" + FUNCTION_WORDS + ")")
REPEATED = re.compile(_LEAD + r"(.{2,12}?)\1{2,}")
STATUS = re.compile(_LEAD + r"[45]\d\d|%[A-Z]")


def may_hold(text: str) -> bool:
    """False only where no pattern of marks, filler or messages can match."""
    return next(cue_automaton().iter(text.lower()), None) is not None or bool(STATUS.search(text) or REPEATED.search(text) or BARE.search(text))


@functools.lru_cache(maxsize=1)
def cue_automaton() -> ahocorasick.Automaton:
    """All cues in one automaton: a text is read once, whatever their number."""
    cues = ahocorasick.Automaton()
    for cue in (*MARK_CUES, *MESSAGE_CUES):
        cues.add_word(cue.lower(), 1)
    cues.make_automaton()
    return cues


def searched(df: DataFrame, key: str) -> DataFrame:
    rows = df.where(F.col("kind").isin(*KINDS) & F.col("text").rlike(r"\S"))
    return rows.select(F.col(key).alias("_key"), F.col("document").alias("_document"), F.col("kind").alias("_kind"), F.col("text").alias("_text"))


def candidates(df: DataFrame, key: str) -> DataFrame:
    """The rows with a candidate for a slot, or that a message or filler may stand in, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([may_hold(t) for t in batch.column(3).to_pylist()], pa.bool_()))

    rows = searched(df, key)
    return cut_lineage(rows.mapInArrow(run, rows.schema))


def segments(rows: DataFrame) -> DataFrame:
    """(_key, _document, _kind, _size, _segment) of the non-blank segments of the rows' texts."""
    parts = F.filter(F.transform(F.split("_text", r"\r?\n| \| "), lambda s: F.rtrim(F.regexp_replace(s, r"^[\s\x{a0}\x{3000}•·*-]+", ""), F.lit(" \t\r\x0b\x0c\xa0\u3000"))), lambda s: s != "")
    return rows.select("_key", "_document", "_kind", F.length("_text").alias("_size"), F.explode(parts).alias("_segment"))


def _inner(filling: Column) -> Column:
    """A slot's filling as a variable's name: without marks, in lower case."""
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(filling, r"\d+", "0"), r"[^\p{L}\p{N}]+", " "), r"(?i)\b(?:insert|here|to be supplied)\b|在此输入|待填|请填写", "")))


LABEL = r"^([^:：]{1,60}[:：][ \t\x{3000}]*)(\S.*)$"
#: A name of a variable that is no word of a text, or the form of a date or number that is to be filled in.
UNMARKED = r"^(?:[a-z]+(?:_[a-z0-9]+)+|[A-Z]+(?:_[A-Z0-9]+)+|(?i:(?:yyyy|dd|mm)[-/.](?:mm|dd|mmm)[-/.](?:yyyy|dd|yy))|[.…·]{6,})$"


def _several(pairs: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """(key, name) of the keys with at least ``RECURS`` different values, counted in two steps."""
    return pairs.select(key, value).distinct().groupBy(key).agg(F.count("*").alias(name)).where(f"{name} >= {RECURS}")


def marked_slots(df: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """(_key) of rows with a slot that still holds a variable, a default or a blank.

    ``df`` is the whole table, whose labelled lines are aligned with those that hold a mark.
    """
    mark = F.regexp_extract_all("_segment", F.lit(f"({MARKS}|{UNSURE})"), F.lit(1))
    marked = parts.where(F.col("_segment").rlike(f"{MARKS}|{UNSURE}")).withColumn("_fillings", mark)
    # aligned: what is left of a segment without its marks is its template
    marked = marked.select("_key", "_document", F.regexp_replace("_segment", f"{MARKS}|{UNSURE}", "§").alias("_template"), F.explode("_fillings").alias("_filling"))
    blank = F.col("_filling").rlike(r"^(?:[^\p{L}\p{N}]+|X+(?:-X+)*|#.*[!?A]|TBD|TBC|TODO|FIXME)$")
    name = F.when(blank, F.lit("")).otherwise(_inner(F.col("_filling")))
    style = F.when(blank, F.regexp_replace("_filling", r"(.)\1+", "$1$1")).otherwise(F.regexp_replace("_filling", r"[\p{L}\p{N}_]+(?:[ _-]+[\p{L}\p{N}_]+)*", "a"))
    marked = marked.select("_key", "_document", "_template", name.alias("_name"), style.alias("_style"), F.col("_filling").rlike(f"^(?:{MARKS})$").alias("_sure"), F.regexp_extract("_template", r"^([^:：§]{1,60}[:：][ \t\x{3000}]*)§", 1).alias("_label"))
    marked = cut_lineage(marked)
    named = marked.where("_name <> ''")
    # a variable: its name stands in several templates, or in several styles of marks
    styles = named.select("_name", "_style").distinct().groupBy("_name").agg(F.count("*").alias("_n")).where("_n >= 2").select("_name")
    names = cut_lineage(_several(named, "_name", "_template", "_n").select("_name").unionByName(styles).distinct())
    # a style of marks: it wraps several names, or, if it is a blank, stands in several templates
    wraps = marked.select("_style", F.when(F.col("_name") != "", F.col("_name")).otherwise(F.concat(F.lit("§"), "_template")).alias("_of"))
    wraps = _several(wraps, "_style", "_of", "_n").select("_style")
    # a mark that is all of a segment recurs over documents
    alone = _several(marked.where("_template = '§'").withColumn("_form", F.concat_ws("§", "_style", "_name")), "_form", "_document", "_n").select("_form")
    # an induced slot: different fillings at the same place of a template, marks or, in other records of a label, values
    slots = _several(marked.where(F.col("_template").rlike(r"\p{L}")).withColumn("_form", F.concat_ws("§", "_style", "_name")), "_template", "_form", "_n").select("_template")
    labels = marked.where("_label <> ''").select("_label").distinct()
    lines = segments(searched(df, key).where(F.col("_text").rlike("[:：]"))).where(F.col("_segment").rlike(LABEL))
    lines = lines.select("_key", F.regexp_extract("_segment", LABEL, 1).alias("_label"), F.regexp_extract("_segment", LABEL, 2).alias("_value"))
    values = cut_lineage(lines.join(labels, "_label", "left_semi"))
    filled = cut_lineage(_several(values.where(~F.col("_value").rlike(f"{MARKS}|{UNSURE}")).withColumn("_value", F.xxhash64("_value")), "_label", "_value", "_n").select("_label"))
    sure = marked.where("_sure")
    found = [sure.where("_template = '§'").withColumn("_form", F.concat_ws("§", "_style", "_name")).join(alone, "_form", "left_semi"), sure.join(wraps, "_style", "left_semi"), sure.join(slots, "_template", "left_semi"), sure.join(filled, "_label", "left_semi"), named.join(names, "_name", "left_semi")]
    # a known name, or the form of a value, in a slot that other records fill
    bare = values.where(F.col("_value").rlike(UNMARKED)).withColumn("_name", _inner(F.col("_value"))).join(filled, "_label", "left_semi")
    found += [bare.where(F.col("_value").rlike("^(?:[.…·]|(?i)[ymd]{2,4}[-/.])")), bare.join(names, "_name", "left_semi")]
    out = found[0].select("_key")
    for more in found[1:]:
        out = out.unionByName(more.select("_key"))
    return out


def messages(parts: DataFrame) -> DataFrame:
    """(_key) of rows that are filler, an error message or a notice about scripts, and no single case of its kind."""

    def whole(text: Column, filler: str = FILLER) -> Column:
        return text.rlike(rf"^(?:{filler})$") | text.rlike(rf"^(?:{ERRORS})$") | text.rlike(rf"^(?:{SCRIPTS})$")

    short = F.length("_segment") <= LINE
    # a page on one line is read by sentences: its first one is a message, and most of the rest goes with it
    sentences = F.split("_segment", r"(?<=[.!?])\s+|(?<=[。！？])\s*(?=\S)")
    going = F.filter(sentences, lambda s: whole(s) | s.rlike(WARNING))
    lengths = F.aggregate(going, F.lit(0), lambda n, s: n + F.length(s) + 1)
    share = F.when(F.col("_segment").rlike(rf"^(?:{FILLER_BEGINS})$"), F.length("_segment")).when(whole(sentences[0]), lengths)
    long = parts.where(~short).withColumn("_part", share).where("2 * _part >= length(_segment)")
    worded = parts.where(short & whole(F.col("_segment"))).withColumn("_part", F.length("_segment")).unionByName(long)
    # a message is a template, too: its beginning and end recur over documents, what varies between them is a slot
    first = F.regexp_replace(F.split("_segment", r"(?<=[.!?])\s+|(?<=[。！？])\s*(?=\S)")[0], r"(?i)[0-9a-f]*\d[0-9a-f]*", "0")
    alone = F.col("_segment").rlike(r"^(.{2,12}?)\1{2,}$")  # what repeats itself needs no other
    ends = F.array(F.concat(F.substring(first, 1, 6), F.lit("…")), F.concat(F.lit("…"), F.substring(first, -6, 6)))
    worded = cut_lineage(worded.withColumn("_frame", F.explode(F.when(alone, F.array(F.lit(""))).otherwise(ends))))
    frames = _several(worded, "_frame", "_document", "_n").select("_frame")
    worded = worded.where("_frame = ''").unionByName(worded.where("_frame <> ''").join(frames, "_frame", "left_semi").select(worded.columns))
    # a segment once, however many of its ends recur
    worded = worded.groupBy("_key", "_kind", "_size", "_segment").agg(F.max("_part").alias("_part"), F.countDistinct("_frame").alias("_ends"), F.count("*").alias("_rows")).withColumn("_part", (F.col("_part") + 1) * F.col("_rows") / F.col("_ends") - 1)
    worded = worded.groupBy("_key").agg(F.first("_kind").alias("_kind"), F.first("_size").alias("_size"), F.sum(F.col("_part") + 1).alias("_covered"))
    worded = worded.where("_kind <> 'text' OR 2 * _covered >= _size").select("_key")
    # shorter ones are single words, but for Chinese
    # warnings that recur word by word while nothing in them varies: their ends frame one and the same middle
    warned = parts.where(((F.length("_segment") >= 8) | F.col("_segment").rlike("^.{0,3}[一-鿿].{3,}")) & F.col("_segment").rlike(WARNING))
    warned = warned.withColumn("_same", F.regexp_replace("_segment", r"[0-9A-F]{6,}|\d+", "0")).withColumn("_frame", F.concat_ws("…", F.substring("_same", 1, 6), F.substring("_same", -6, 6)))
    recurring = (
        warned.groupBy("_frame", "_document")
        .agg(F.min("_same").alias("_low"), F.max("_same").alias("_high"))
        .groupBy("_frame")
        .agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"), F.count("*").alias("_documents"))
        .where(f"_low = _high AND _documents >= {RECURS}")
        .select(F.col("_low").alias("_same"))
    )
    recurring = warned.where("_kind <> 'text' OR 2 * length(_segment) >= _size").join(recurring, "_same", "left_semi").select("_key")
    return worded.unionByName(recurring)


def filler_prose(parts: DataFrame) -> DataFrame:
    """(_key) of rows written in filler words: words that recur in sentences without any function word."""
    latin = parts.where(F.col("_segment").rlike(r"^[A-Za-z ,.;'\-]{24,}$"))
    latin = latin.withColumn("_bare", ~F.col("_segment").rlike(FUNCTION_WORDS) & F.col("_segment").rlike(r"\.$"))
    words = F.array_distinct(F.regexp_extract_all(F.lower("_segment"), F.lit(r"([a-z]{4,})"), F.lit(1)))
    spelled = latin.select("_key", "_kind", "_size", "_segment", "_bare", words.alias("_words"))
    bare = spelled.where("_bare AND size(_words) >= 4")
    induced = bare.select(F.explode("_words").alias("_word")).groupBy("_word").agg(F.count("*").alias("_n")).where(f"_n >= {RECURS}").select("_word")
    scored = spelled.where("_bare AND size(_words) >= 2").select("_key", "_kind", "_size", "_segment", F.size("_words").alias("_n"), F.explode("_words").alias("_word")).join(induced, "_word", "left_semi")
    scored = scored.groupBy("_key", "_kind", "_size", "_n", F.xxhash64("_segment").alias("_id"), F.length("_segment").alias("_length")).count().where("count >= 0.8 * _n")
    scored = scored.groupBy("_key", "_kind", "_size").agg(F.sum("_length").alias("_covered"))
    return scored.where("_kind <> 'text' OR 2 * _covered >= _size").select("_key")


def find_residue(df: DataFrame, key: str = "row_id") -> DataFrame:
    """(key) of the rows of kinds text and shape_description that hold residue in place of content, each once.

    Null and blank texts, other kinds and rows that only speak about errors, templates, samples or scripts are none.
    """
    rows = candidates(df, key)
    parts = cut_lineage(segments(rows))  # five steps read them
    found = marked_slots(df, parts, key).unionByName(messages(parts)).unionByName(filler_prose(parts))
    return found.distinct().select(F.col("_key").alias(key))


def without_residue(df: DataFrame, key: str = "row_id") -> DataFrame:
    """The rows of ``df`` that later stages keep."""
    found = find_residue(df, key).select(F.col(key).alias("_found"))
    return df.join(found, df[key] == found["_found"], "left_anti")
