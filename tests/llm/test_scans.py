from docweft.llm import scans

SCHEMA = "row_id long, document string, location string, text string, noise string"
FIRST = ("Oil is filled in at the top of the", "Remove dust from the fan of every", "Two screws hold the lower lid of a", "Never open any part of a running", "Tests have shown no leaks in this", "Cables are led through a gland to the", "Store in a dry room: parts of the", "Read all notes on handling of each", "After a year a fitter checks any", "Paint must not cover the plate of a", "Noise may tell you of a worn", "Only trained staff may move this")
BODY = (
    "pump. Before you inspect the control board, clean the fuse holder\nand make sure that nothing blocks the supply voltage. The\n"
    "high-pressure pump protects the network connection under\nnormal conditions and carries the working stroke.\n"
)


def body(i):
    return f"{FIRST[i % 12]}\n{BODY}"


def rows(spark, *pages, document="d"):
    return spark.createDataFrame([(n, document, f"page:{p}/ocr", t, "x") for n, (p, t) in enumerate(pages)], SCHEMA)


def noise(df):
    out = {}
    for r in scans.page_noise(df).collect():
        out.setdefault(r.row_id, set()).add(r.noise)
    return out


def test_kinds(spark):
    pages = [(i, f"Operating Manual pump Rev. E\n{body(i)}Page {i}") for i in range(1, 13)]
    pages[3] = (4, f"OPERATING MANVAL PUMP REV. E\n{body(4)}")
    pages[4] = (5, body(5).replace("control", "contr0l"))
    pages[5] = (6, body(6).replace("connection under\n", "connec-\ntion under "))
    pages[6] = (7, body(7).replace("The\nhigh-pressure", "The high-\npressure"))
    pages[7] = (8, "8\n" + body(8).replace("working", "vvorking"))
    pages[8] = (9, body(9))
    got = noise(rows(spark, *pages))
    assert got[0] == {"header", "page_number"} and got[3] == {"header"} and got[4] == {"misread"} and got[5] == {"hyphenation"} and got[7] == {"page_number", "misread"}
    assert 6 not in got and 8 not in got


def test_repair(spark):
    pages = [(i, f"Operating Manual pump Rev. E\n{body(i)}Page {i}") for i in range(1, 9)] + [(9, body(9).replace("control", "c0ntrol").replace("connection under\n", "connec¬\ntion under ")), (10, body(10).replace("The\nhigh-pressure", "The high-\npressure"))]
    out = {r.row_id: r.text for r in scans.repaired_pages(rows(spark, *pages)).collect()}
    assert [out[n] for n in (0, 8, 9)] == [" ".join(body(i).split()) for i in (1, 9, 10)]


def test_chinese(spark):
    lead = "泵阀轴盖罩架杆环座台座槽管"
    text = "操作人员可以从正面检查轴承座，但是必须等待残余\n压力完全释放。外壳由耐磨材料制成，因此不需要额\n外防护。轴承座由耐磨材料制成，残余压力不大。\n"
    pages = [(i, f"{lead[i] * i}，\n{lead[i - 1] * 9}；\n" + text) for i in range(1, 12)] + [(12, text.replace("残余\n压力", "残余\n庄力", 1))]
    df = rows(spark, *pages)
    assert noise(df) == {11: {"misread"}}
    fixed = {r.row_id: r.text for r in scans.repaired_pages(df).collect()}
    assert fixed[11] == text.replace("\n", "") and fixed[0] == "阀，" + "泵" * 9 + "；" + text.replace("\n", "")


def test_headers_need_three_pages(spark):
    two = rows(spark, (1, "Pump Manual Rev. A\n" + BODY), (2, "Pump Manual Rev. A\n" + BODY))
    assert noise(two) == {}
    redelivered = two.unionByName(two)
    assert noise(redelivered) == {}


def test_number_lines():
    for line in ("Page 7", "p. 7", "第7页 共26页", "第 7 页", "- 7 -", "· 7 ·", "7", "7 |", "7 / 29", "Page 7 of 30"):
        assert scans.is_number_line(line, 7), line
    for line in ("8", "7 seconds.", "7.3%。", "Page", "", "7 mm"):
        assert not scans.is_number_line(line, 7), line


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "page:1/ocr", BODY, "x"), (2, "d", "page:2/ocr", None, "x"), (3, "d", "page:3/ocr", " \n ", "x"), (4, "d", "page:4/line:1", BODY, "x"), (5, "d", None, BODY, "x"), (6, "d", "page:6/ocr", "word " * 50_000, "x")], SCHEMA)
    assert {r.row_id for r in scans.repaired_pages(df).collect()} == {1, 6}
    assert scans.page_noise(df.where("false")).count() == 0


def test_large_vocabularies_are_joined(spark, monkeypatch):
    monkeypatch.setattr(scans, "BROADCAST_FORMS", 0)
    pages = [(i, body(i)) for i in range(1, 12)] + [(12, body(12).replace("control", "contr0l"))]
    assert noise(rows(spark, *pages)) == {11: {"misread"}}


def test_titles_of_long_documents(spark):
    words = [f"{a}{b}" for a in "bcdfghklmnp" for b in ("arum", "olit", "enda", "imos", "ugat", "ylor", "esic", "opan", "irta", "adul")]
    pages = [(i, f"{words[i % 109].title()} {words[(7 * i) % 103]} {words[(11 * i) % 101]} stands beside\n{BODY}{words[(3 * i) % 101]} {words[(5 * i) % 107]} ends.\n") for i in range(1, 301)]
    for i in range(20, 30):
        pages[i] = (pages[i][0], "Installation and Operating Manual\n" + pages[i][1])
    for i in range(40, 50):  # a line of the text that recurs at the head of pages goes on in the next one
        pages[i] = (pages[i][0], "In most plants the pump is installed next to a larger\nmixing head and the " + pages[i][1][0].lower() + pages[i][1][1:])
    got = noise(rows(spark, *pages))
    assert {n for n, kinds in got.items() if "header" in kinds} == set(range(20, 30))


def test_padded_number_lines():
    for line in (" " * 45 + "7", "Page" + " " * 50 + "7" + " " * 30, "-" * 30 + " 7 " + "-" * 30, "7" + " " * 60 + "/" + " " * 60 + "29", "第" + "　" * 50 + "7页"):
        assert scans.is_number_line(line, 7), line
    for line in (" " * 45 + "8", "7" + " " * 50 + "mm", "7" * 5000, "7" + " -" * 20_000 + "x", "第7页" + " " * 20_000 + "x"):
        assert not scans.is_number_line(line, 7), line[:60]


def test_join_and_broadcast_agree(spark, monkeypatch):
    pages = [(i, body(i)) for i in range(1, 14)]
    pages += [
        (14, body(14).replace("control", "con-\ntr0l")), (15, body(15).replace("high-pressure pump protects", "high-\npre5sure pump protects")), (16, body(16).replace("connection", "con-\nnec-\nti0n")),
        (17, body(17).replace("normal", "n0r-\nmal").replace("inspect", "in5pect")), (18, body(18).replace("control", "contr0l").replace("supply voltage", "pre5sure").replace("working", "vvorking")),
    ]
    lead = "泵阀轴盖罩架杆环座台座槽管"
    text = "操作人员可以从正面检查轴承座，但是必须等待残余\n压力完全释放。外壳由耐磨材料制成，因此不需要额\n外防护。"
    pages += [(20 + i, f"设备说明书｜第2版\n{lead[i] * i}，\n{lead[i - 1] * 9}；\n" + text) for i in range(1, 12)] + [(40, "设备说明书｜第2版\n" + text.replace("残余\n压力", "残余\n庄力", 1)), (41, "设备说明书｜第2版\n压力完全释放。" + text.replace("压力完全", "庄力完全"))]
    df = rows(spark, *pages)
    one = {r.row_id: (r.text, r.noise) for r in scans.repaired_pages(df).collect()}
    monkeypatch.setattr(scans, "BROADCAST_FORMS", 0)
    assert {r.row_id: (r.text, r.noise) for r in scans.repaired_pages(df).collect()} == one
    assert all("misread" in one[n][1] for n in (13, 14, 17))


def test_model_is_fitted_and_departs_from_the_rules(spark):
    """Titles at the head of pages are paragraphs of their own where the rules, which only know recurring lines, would run
    them into the text: the fitted model tells them by place, width and end."""
    rows = []
    for d in range(12):
        for p in range(1, 5):
            body = "\n".join(f"The pump {d} on page {p} is mounted upright and wired as shown in part {k} of the book." for k in range(6))
            head = f"Manual {d} Edition\n" if d < 11 else ("Pump Handbook\n" if p == 1 else "")
            rows.append((100 * d + p, f"d{d}", f"page:{p}/ocr", head + body))
    df = spark.createDataFrame(rows, "row_id long, document string, location string, text string")
    out = {r.row_id: r for r in scans.repaired_pages(df).collect()}
    assert all("header" in out[100 * d + p].noise for d in range(11) for p in range(1, 5))
    assert out[1101].text.split("\n\n")[0] == "Pump Handbook" and "header" not in out[1101].noise


def test_expectations_are_exact():
    """Forward-backward over pages of several lengths equals the sum over all label sequences."""
    import itertools
    import math
    import random

    chance = random.Random(3)
    counts = {(a, b): chance.random() for a in ("start", *scans.LABELS) for b in scans.LABELS} | {(a, v): chance.random() for a in scans.LABELS for g in scans.GROUPS for v in g}
    model = scans._probabilities(counts)
    kinds = [tuple(chance.choice(g) for g in scans.GROUPS) for _ in range(4)]
    pages = [[chance.choice(kinds) for _ in range(n)] for n in (1, 2, 3, 3)] + [[]]
    want = {}
    for page in filter(None, pages):
        paths = list(itertools.product(scans.LABELS, repeat=len(page)))
        scores = [math.exp(sum(model[a][v] for a, f in zip(path, page, strict=True) for v in f) + sum(model[f"{a}>"][b] for a, b in zip(("start", *path), path, strict=False))) for path in paths]
        for path, score in zip(paths, scores, strict=True):
            for a, b in zip(("start", *path), path, strict=False):
                want[a, b] = want.get((a, b), 0) + score / sum(scores)
            for a, f in zip(path, page, strict=True):
                for v in f:
                    want[a, v] = want.get((a, v), 0) + score / sum(scores)
    got = scans.expectations(pages, model)
    assert all(abs(got[k] - n) < 1e-9 for k, n in want.items()) and abs(sum(got.values()) - sum(want.values())) < 1e-9
