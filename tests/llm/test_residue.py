import re

import pytest
from hypothesis import HealthCheck, assume, given, settings
from hypothesis import strategies as st

from docweft.llm import residue

SCHEMA = "row_id long, document string, kind string, text string, _key string"


def rows(spark, *texts, kind="text"):
    return spark.createDataFrame([(i, f"d{i}", kind, t, "k") for i, t in enumerate(texts)], SCHEMA)


def found(df):
    """The rows found, without those that are only there to support others."""
    return sorted(r.row_id for r in residue.find_residue(df).collect() if r.row_id >= 0)


STYLES = ("{{ %s }}", "${%s}", "[[%s]]", "<在此输入%s>", "［待填：%s］", "【请填写%s】", "[insert %s here]", "<%s to be supplied>", "@@%s@@", "%%%s%%")


def support(spark):
    """Other records of the same templates: no mark stands alone, and no message is the only one of its kind."""
    marks = [f"{label}: {style % (name.upper() if style[0] in '@%' else name)}" for style in STYLES for label, name in (("Load", "product_name"), ("Width", "title"), ("Gap", "model"))]
    blanks = [f"{label} {blank}" for blank in ("________", "#REF!", "XXXX-XX", "[  ]") for label in ("Depth:", "Mass:", "Height:")]
    texts = [*marks, *blanks, *(t for t in (*BAD, LOREM, PAGE) for _ in range(3))]
    return spark.createDataFrame([(-1 - i, f"s{i}", "text", t, "k") for i, t in enumerate(texts)], SCHEMA)


BAD = [
    "{{ model }}", "The pump from ${name} runs.", "Accuracy: ________\nWeight: 5 kg", "[[标题]]", "<在此输入型号>泵", "［待填：流量］", "【请填写额定电压】", "[insert product name here]", "The valve from <title to be supplied> limits it.", "流量：@@TITLE@@", "型号：%MODEL%", "#REF!", "XXXX-XX", "重量：[  ]",
    "Sample text Sample text goes here", "Click here to edit the title style", "单击此处编辑正文样式", "此处为占位内容，请替换为标题", "Dummy paragraph - delete in final version", "（样板段落，定稿前删除）", "示例文字示例文字", "Second level\nThird level", "Your slogan here",
    "无法显示链接的图片，文件可能已被移动或重命名。", "404 您请求的页面不存在或已被移除", "Internal error, request id AA2A1037", "Service busy (503). Please retry in a few minutes.", "Access denied: you are not allowed to open this document.", "加载失败：请求编号 DD63DF18", "错误！找不到书签“流量”。", "Bad gateway\nupstream did not answer\nref 29B2D7", "会话已过期，请重新登录后查看本页。",
    "You need to enable JavaScript to view this page.", "Scripts are blocked in your browser, so the model cannot be displayed.", "请启用脚本后重新加载本页面。", "检测到脚本被拦截，请关闭拦截插件后刷新。", "Please switch on scripts and cookies, then refresh.",
]
GOOD = [
    "If the panel shows error 17, check the wiring of the encoder and restart the gateway.", "The gateway answers requests to unknown registers with status 503 and keeps running.", "Start-up scripts of the gateway run before the valve is released.", "A sample of 74 ml is drawn through the guide rail.",
    "Use the drilling template supplied with the valve.", "When the browser page of the valve stays empty, press reset and wait 59 seconds.", "示例：流量为90 L/min时，选用7号散热风扇。", "配方脚本必须在伺服驱动器启动前加载完成，否则控制板不工作。", "面板显示错误500时，检查外壳的通信线路并重新上电。", "若界面提示“页面不存在”，请将泵固件升级后再试。", "权限等级不足时，泵只能查看，不能修改供电电压。", "Weight: 5 kg",
]


def test_told_apart(spark):
    assert found(rows(spark, *BAD, *GOOD).unionByName(support(spark))) == list(range(len(BAD)))


def test_lists_flag_nothing_alone(spark):
    """A mark, a message or filler of a list that no other record resembles is no case."""
    assert found(rows(spark, "The pump from ${name} runs.", "[[标题]]", "#REF!", "XXXX-XX", "Your slogan here", "Bad gateway", "404 page not found", "检测到脚本被拦截，请关闭拦截插件后刷新。")) == []


def test_slots_are_induced(spark):
    marks = ["Rotor {{ bore }} of steel", "Rotor %BORE% of steel", "Rotor ____ of steel", "Rotor XXXX of steel"]
    assert found(rows(spark, *marks, "Rotor 7 of steel")) == [0, 1, 2, 3]
    # a blank in a label that other records fill, and a name that is known from elsewhere without its mark
    filled = ["Bore: 5 mm", "Bore: 7 mm", "Bore: 9 mm"]
    assert found(rows(spark, *filled, "Bore: ____", "Bore: ${shaft_bore}", "Bore: shaft_bore", "Bore: ......", "Use {{ shaft_bore }} here", "Note: shaft_bore")) == [3, 4, 5, 6, 7]
    assert found(rows(spark, "Bore: 5 mm", "Bore: 7 mm", "Bore: ____")) == []


def test_unsure_marks_need_support(spark):
    assert found(rows(spark, "The «flow» of oil", "Press «start» twice")) == []
    assert found(rows(spark, "The «flow_rate» of oil", "Type {{ flow_rate }}")) == [0, 1]
    assert found(rows(spark, "Weight: {1}", "Size {0} of pump", "Use {2} now", "a {12}")) == [0, 1, 2, 3]


def test_filler_words_are_induced(spark):
    lorem = ["Pradit anelum cordeno loremi consera solvate.", "Consera pradit loremi anelum cordeno solvate parede.", "Anelum solvate cordeno pradit consera loremi."]
    assert found(rows(spark, *lorem, "The pradit valve is open and the pump is closed.")) == [0, 1, 2]


def test_repeated_warnings(spark):
    same = ["Viewer refresh denied by host seven"] * 4
    varied = [f"Press reset to retry the {x} at once" for x in ("pump", "valve", "motor", "shaft")]
    assert found(rows(spark, *same, *varied)) == [0, 1, 2, 3]


def test_descriptions_and_kinds(spark):
    assert found(rows(spark, "Picture 92 | 无法显示链接的图片，文件可能已被移动或重命名。", "Shape 2 | pump | Accessories", "图片 46 | 流量：{{ cover_image }}", kind="shape_description").unionByName(support(spark))) == [0, 2]
    assert found(rows(spark, "{{ model }}", kind="table")) == []


def test_edges(spark):
    df = rows(spark, None, "", "  ", "x " * 100_000 + "{{ model }}")
    assert found(df.unionByName(support(spark))) == [3] and found(df.where("false")) == []
    assert residue.without_residue(df.unionByName(support(spark))).where("row_id >= 0").count() == 3
    assert found(rows(spark, "{{ a }}").unionByName(rows(spark, "{{ a }}")).unionByName(support(spark))) == [0]


def plain(pattern):
    return re.sub(r"\\x\{([0-9a-f]{2,4})\}", lambda m: chr(int(m[1], 16)), pattern)


@pytest.mark.parametrize("name", ["MARKS", "UNSURE", "FILLER_BEGINS", "UNANCHORED", "ERRORS", "SCRIPTS"])
def test_cues_miss_nothing(name):
    """Strings generated from the patterns, also behind bullets and tabs, all pass the filter before them."""

    @settings(max_examples=400, deadline=None, database=None, suppress_health_check=list(HealthCheck))
    @given(st.sampled_from(("", "• ", "- ", "\t", "Shape 2 | ", "Pump\n")), st.from_regex(re.compile(plain(getattr(residue, name)), re.ASCII), fullmatch=True))
    def check(lead, text):
        assume("\n" not in text and text.isprintable() and text.strip() == text)
        assert residue.may_hold(lead + text)

    check()
    for text in ("System down for maintenance", "Site temporarily down", "The system down, try later", "Page down for repair today", "• 产品产品产品", *BAD):
        assert residue.may_hold(text), text


LOREM = (
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. "
    "Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum."
)


PAGE = "The page you requested could not be found. " + "Check the address in your browser or reload the page from the start page of this server. " * 5


def test_long_lines(spark):
    page = PAGE
    prose = "The page you requested could not be found. " + "The valve is mounted upright on a flat wall and wired as shown in the drawing beside it. " * 5
    safety = "The pump is delivered with two locks on the shaft. Remove before delivery to the end customer. " + "The oil is changed once a year by trained staff. " * 8
    assert min(map(len, (LOREM, page, prose, safety))) > 400
    assert found(rows(spark, LOREM, page, prose, safety).unionByName(support(spark))) == [0, 1]
    warning = "Viewer 7 reports: the drawing cannot be shown because the connection to the archive was closed before all of its parts had arrived here."
    assert len(warning) > 120 and found(rows(spark, warning, warning, warning, "Valve")) == [0, 1, 2]


def test_templates_and_documents_are_counted_exactly(spark):
    ids = [r.id for r in spark.range(2000).selectExpr("id", "pmod(xxhash64(concat('Part ', id, ' fits §')), 64) AS h").where("h = 7").orderBy("id").limit(3).collect()]
    assert found(rows(spark, *[f"Part {i} fits «model»" for i in ids])) == [0, 1, 2]
    ids = [r.id for r in spark.range(2000).selectExpr("id", "pmod(xxhash64(concat('d', id)), 64) AS h").where("h = 7").orderBy("id").limit(3).collect()]
    df = spark.createDataFrame([(i, f"d{i}", "text", "Archive reports that the drawing cannot be shown", "k") for i in ids], SCHEMA)
    assert found(df) == ids
