import random

import pytest

from docweft.llm import personal as P


def found(text):
    return {(text[a:b], k) for a, b, k in P.spans(text)}


@pytest.mark.parametrize(
    ("text", "values"),
    [
        ("Contact: Michael Quarseveley\nTel: 617.555.0133\nE-mail: f.mun@sav.test", {("Michael Quarseveley", "name"), ("617.555.0133", "phone"), ("f.mun@sav.test", "email")}),
        ("问题反馈至kate.wil (at) kor [dot] mail [dot] example。", {("kate.wil (at) kor [dot] mail [dot] example", "email")}),
        ("如需备件请联系严汐，手机154-6819-5176，邮箱sales＠no.example.com。", {("严汐", "name"), ("154-6819-5176", "phone"), ("sales＠no.example.com", "email")}),
        ("验收人韩筠（身份证号10635119780409248X）已签字。", {("韩筠", "name"), ("10635119780409248X", "id_number")}),
        ("退换货请寄至岚江省沧屿市东汀区石桥东路653号9栋12室，电话(0334) 5412717。", {("岚江省沧屿市东汀区石桥东路653号9栋12室", "address"), ("(0334) 5412717", "phone")}),
        ("Deliver to Unit 6, 447 Tannery Rd., Eastwick Vale QX57 5ZZ and wait.", {("Unit 6, 447 Tannery Rd., Eastwick Vale QX57 5ZZ", "address")}),
        ("Badge holder Yusra Radvulero, passport or identity number 937-23-4365, may enter.", {("Yusra Radvulero", "name"), ("937-23-4365", "id_number")}),
        ("Checked by: Dr. XANLAREICK William\nPrepared by: Meg, Abdalhart", {("XANLAREICK William", "name"), ("Meg, Abdalhart", "name")}),
        ("审核：汐湛 曹\n编制：严 岫 淮工程师", {("汐湛 曹", "name"), ("严 岫 淮", "name")}),
        ("周舒湛女士于上周到访，留下号码0333-3426364-802。", {("周舒湛", "name"), ("0333-3426364-802", "phone")}),
        ("持证人证件号码 E44559111，培训由郑槿负责。", {("E44559111", "id_number"), ("郑槿", "name")}),
        ("培训由严筠芷负责，联系人：蒋湛", {("严筠芷", "name"), ("蒋湛", "name")}),
        ("call +４４ ７７００ ９００９３６ now", {("+４４ ７７００ ９００９３６", "phone")}),
        ("ring five five five one two three four five six seven please", set()),
    ],
)
def test_found(text, values):
    assert found(text) == values


@pytest.mark.parametrize(
    "text",
    ["Connector M12@24V, 5 poles", "订货号 13900-228072-07，适配盖板。", "Order code 415-4909-9819 replaces the former type.", "默认网关地址为10.95.82.1，端口502。", "Lot 2024-03-20 passed", "出厂编号100173198910135372，请勿撕毁标签。", "批次2024042018133518已检验合格。", "Manufacturer: Tulurbrask Controls Engineering", "Route the cable along duct 8 and keep 38 mm from the wall.", "", "Prepared by: TBD", "审核：待定"],
)
def test_nothing(text):
    assert found(text) == set()


def test_offsets_survive_rewriting():
    text = "​联系人：韩筠​ mail a​b＠c．example (dot) org 完"
    for start, end, _ in P.spans(text):
        assert text[start:end] == text[start:end].strip()
    assert ("a​b＠c．example (dot) org", "email") in found(text)


def test_cells():
    rows = [["姓名", "电话", "邮箱"], ["魏漪昀", "", "x@y.test"], ["严 汐", None, ""], None, ["精度", "IP54"]]
    assert {(i, j, k) for i, j, _, _, k in P.cell_spans(rows)} == {(1, 0, "name"), (1, 2, "email"), (2, 0, "name")}
    mixed = [["Item", "Value"], ["Weight", "5 kg"], ["Frederick Bosnarihart", "201-555-0192"]]
    assert {(i, j, k) for i, j, _, _, k in P.cell_spans(mixed)} == {(2, 0, "name"), (2, 1, "phone")}
    assert P.cell_spans(None) == [] and P.cell_spans([]) == []


SCHEMA = "row_id long, kind string, text string, rows array<array<string>>, value string"


def test_tables(spark):
    df = spark.createDataFrame(
        [(1, "text", "write to a@b.test or a@b.test", None, "v"), (2, "image", "a@b.test", None, "v"), (3, "table", None, [["Mail"], ["c@d.test"], None, [None]], "v"), (4, "text", None, None, "v"), (5, "text", "", [], "v"), (6, "text", "y" * 300_000, None, "v")], SCHEMA
    )
    assert sorted(tuple(r) for r in P.find_personal(df).collect()) == [(1, "text", "email", "a@b.test"), (3, "rows", "email", "c@d.test")]
    out = {r.row_id: r for r in P.redact(df).collect()}
    assert out[1].text == "write to [EMAIL] or [EMAIL]" and out[2].text == "a@b.test" and out[3].rows == [["Mail"], ["[EMAIL]"], None, [None]] and out[4].text is None and out[5].rows == []
    assert P.find_personal(df.where("false")).count() == 0


def test_cues_miss_nothing():
    """Every text that the detectors find something in passes the cheap look before them."""
    texts = ["Contact: A. Bcdef", "call +４４ ７７００ ９００９３６ now", "Yesterday Oren Casp called from 201-555-0147 about it.", "a (at) b (dot) org", "写信到x＠y．org", "由严汐负责", "Robert Tables was here", "住在岚江省沧屿市东汀区石桥东路6号"]
    assert [t for t in texts if not P.maybe_personal(t) and P.spans(t)] == []


@pytest.mark.parametrize(
    "text",
    [
        "由王芳签收。", "请转王芳，", "call J. Smith, then wait", "made by Anna Li, twice", "by Anna McDonald,", "NI number AB123456C", "ID 12345", "passport no. 12 345", "call ID１２３４５ now", "护照 E12345", "visitor ANNA O'NEIL,",
        "ring 555[.]123[.]4567 now", "a\tat\tb\tdot\tcom", "ring 0044 five five five one two three", "社保号码：12 345", "Мr Anna Li, in", "一联​系王芳，", "٣ Long Quay",
    ],
)
def test_cues_miss_nothing(text):
    assert not P.spans(text) or P.maybe_personal(text)


def test_cues_cover_random_matches():
    rng = random.Random(5)
    leads = ["", "联系", "由", "转", "由 ", "by ", "with ", "call Dr. ", "visitor ", "NI no. ", "ID ", "iDentity ", "护照号 ", "SSN:", "contact ", "Mr ", "at ", "致电"]
    middles = ["王芳", "欧阳修", "J. Li", "Anna Li", "ANNA LI", "Jo McX", "Anna B. O'N", "12345", "E12-34 56", "+47 12345678", "+125", "(0334) 5412717", "j@x.yz", "j(at)x[.]yz", "7 Old Quay", "x市和路9号"]
    ends = ["", ",", "，", "签收", " on", " called", "。", "负责", "先生", "\n", ";", "C"]
    wide = {i: i + 0xFEE0 for i in range(48, 58)} | {32: 0xA0, 65: 0x410, 97: 0x430, 46: 0xFF0E}
    seen = 0
    for _ in range(20_000):
        text = rng.choice(leads) + rng.choice(middles) + rng.choice(ends)
        if rng.random() < 0.4:
            text = "".join(chr(wide[ord(c)]) if ord(c) in wide and rng.random() < 0.5 else c + "​" * (rng.random() < 0.1) for c in text)
        if P.spans(text):
            seen += 1
            assert P.maybe_personal(text), text
    assert seen > 5000


@pytest.mark.parametrize("rows", [[["ID", "x"], ["12345", ""]], [["Passport", "x"], ["A1 2 3 4", ""]], [["\xa0Name\r", "x"], ["Anna Li", ""]]])
def test_cues_cover_tables(rows):
    assert P.cell_spans(rows) and P.maybe_table("\n".join(c for r in rows for c in r))


def test_short_numbers_are_no_phones():
    assert found("operates up to +125 °C") == set() and found("由先生，") == set()
    assert found("ring +47 12345678 now") == {("+47 12345678", "phone")}
