import itertools

import pytest

from docweft.llm import variants as V

FIRM = ["Tulurbrask Controls Engineering Co., Ltd.", "TULURBRASK CONTROLS ENGINEERING CO., LTD.", "Tulur-brask Controls Engineering Co., Ltd.", "Tulur brask Controls Engineering Co., Ltd.", "Controls Engineering, Tulurbrask", "Tulurbrask Ctrls Eng. Ltd", "Tulurbrask C.E. Company Limited", "Tulurbrask Controls Engineering (Northmere) Ltd", "Tulurbrask Co Ltd", "Tulubrrask Controls Engineering Co., Ltd."]
OTHER = ["Tulurbrask Packaging Flow GmbH", "Tulurbrask Pkg. Flow Gesellschaft mbH", "Packaging Flow (Tulurbrask) G.m.b.H."]
HAN = ["沧屿市智泰翎流体设备股份有限公司", "沧屿智泰翎 流体设备 股份有限公司", "智泰翎流体设备（沧屿）股份有限公司", "沧屿市智泰翎流体設備股份有限公司", "沧屿市志泰翎流体设备股份有限公司", "智泰翎流体设备", "沧屿智泰翎", "智泰翎集团", "智泰翎沧屿流体设备股份有限公司"]
HAN_OTHER = ["汀州湾市智泰宏阀门有限公司", "智泰宏阀门（汀州湾）有限公司", "沧屿市朗博岳阀门有限公司", "朗博岳阀门(沧屿)有限公司"]
PEOPLE = [["William Xanlareick", "XANLAREICK William", "Xanlareick, Will", "W. Xanlareick", "Dr. William H. Xanlareick", "Wililam Xanlareick", "William Xanlraeick"], ["Margaret Xanlareick", "Meg Xanlareick"], ["严 岫 淮", "严岫淮工程师", "岫淮 严", "严岫淮"]]


def linked(spark, orgs, people=()):
    rows = [(n, False, 3) for n in orgs] + [(n, True, 3) for n in people]
    out = {}
    for r in V.link_variants(spark.createDataFrame(rows, "name string, person boolean, weight long")).collect():
        out.setdefault((r.person, r.entity), set()).add(r.name)
    return {frozenset(v) for v in out.values()}


def test_organisations(spark):
    got = linked(spark, FIRM + OTHER + HAN + HAN_OTHER)
    assert {frozenset(FIRM), frozenset(OTHER), frozenset(HAN), frozenset(HAN_OTHER[:2]), frozenset(HAN_OTHER[2:])} == {g for g in got}


def test_people(spark):
    got = linked(spark, [], [n for p in PEOPLE for n in p])
    assert got == {frozenset(p) for p in PEOPLE}


def test_pairs(spark):
    df = spark.createDataFrame([("b", False, "x", 1), ("a", False, "x", 1), ("c", True, "x", 1)], "name string, person boolean, entity string, weight long")
    assert [tuple(r) for r in V.variant_pairs(df).collect()] == [("a", "b")]


def test_spellings(spark):
    terms = spark.createDataFrame([(["A Ltd", None, "n/a", "A Ltd"],), (None,), ([],), (["待确认", " "],)], "manufacturer_terms array<string>")
    texts = spark.createDataFrame([("Weight: 3\nMade by: B GmbH\r\nChecked by: X Yz",), ("制造商：丙有限公司",), ("Supplier: see nameplate",), ("xMade by: no",), (None,), ("",)], "text string")
    rows = {(r.name, r.person, r.weight) for r in V.spellings(terms, texts).collect()}
    assert rows == {("A Ltd", False, 2), ("B GmbH", False, 1), ("X Yz", True, 1), ("丙有限公司", False, 1)}


def test_empty(spark):
    assert V.variant_pairs(V.link_variants(spark.createDataFrame([], "name string, person boolean, weight long"))).count() == 0


def test_nameless_cores_stay_apart(spark):
    assert linked(spark, ["Limited", "Engineering GmbH", "公司"]) == {frozenset(["Limited"]), frozenset(["Engineering GmbH"]), frozenset(["公司"])}


def test_collision_curve():
    """The bands find slips as often as the curve says, measured on the signatures themselves."""
    words = ["".join(p) for p in itertools.islice(itertools.product("tulmarekon", "aeiou", "rskvd", "eoai", "lnmrt", "oa", "frndk", "isu"), 0, 40_000, 199)]
    met = total = 0
    for w in words:
        slip = w[:3] + w[4] + w[3] + w[5:]
        if slip != w:
            total += 1
            met += bool(set(V.signature(w, *V.LATIN)) & set(V.signature(slip, *V.LATIN)))
    assert met / total >= 0.9
    assert V.collision(0.5, *V.LATIN) > 0.999 and V.collision(0.05, *V.LATIN) < 0.01 and V.collision(0.4, *V.HAN) > 0.99


def test_close_cores(spark):
    df = spark.createDataFrame([(False, c) for c in ("korimniblen", "korminiblen", "korimnibblen", "savimramire", "智泰翎", "志泰翎", "智泰宏")], "person boolean, core string")
    got = {tuple(sorted((r.core, r.other))) for r in V.close_cores(df).collect()}
    assert {("korimniblen", "korminiblen"), ("korimnibblen", "korimniblen"), ("志泰翎", "智泰翎"), ("智泰宏", "智泰翎")} <= got and not any("savimramire" in p for p in got)


@pytest.mark.parametrize(("a", "b", "same"), [("pkg.", "packaging", True), ("e.", "engineering", True), ("flow", "controls", False), ("enigneering", "engineering", True), ("systems", "sensors", False)])
def test_words(a, b, same):
    assert (V.word_similarity(a, b) >= V.FITS) is same


def entities(spark, *weighted):
    names = spark.createDataFrame([(n, False, w) for n, w in weighted], "name string, person boolean, weight long")
    return {r.name: r.entity for r in V.link_variants(names).collect()}


def test_short_cores_meet(spark):
    got = entities(spark, ("Acme Motion Controls Ltd", 9), ("Acne Motion Controls Ltd", 1), ("Nova Flow Systems Ltd", 4), ("Nowa Flow Systems Ltd", 4))
    assert got["Acne Motion Controls Ltd"] == got["Acme Motion Controls Ltd"] and got["Nova Flow Systems Ltd"] != got["Nowa Flow Systems Ltd"]


def test_long_chains_end_at_one_centre(spark):
    core = "abcdefghijklm"
    chain = [("z" * k + core[k:]).capitalize() + " Flow Systems Ltd" for k in range(len(core))]
    assert len(set(entities(spark, *((n, 3**k) for k, n in enumerate(chain))).values())) == 1


def test_places_are_joined(spark):
    names = spark.createDataFrame([("苏州市华泵设备有限公司", False, 1), ("苏州市东仪科技有限公司", False, 1), ("华泵（苏州）设备有限公司", False, 1), ("Acme Ltd", False, 1), ("苏州", True, 1)], "name string, person boolean, weight long")
    got = {(r.name, r.person): r.places for r in V.with_places(names).collect()}
    assert len(got) == 5 and got["华泵（苏州）设备有限公司", False] == ["苏州"] and got["苏州", True] is None and got["Acme Ltd", False] is None
