import itertools
import unicodedata

from docweft.llm import lookalikes

SCHEMA = "row_id long, document string, text string, canonical string"


def rows(spark, *texts, document="d"):
    return spark.createDataFrame([(i, document, t, "x") for i, t in enumerate(texts)], SCHEMA)


def pairs(df):
    return sorted(tuple(r) for r in lookalikes.lookalike_pairs(df).collect())


def test_same_look(spark):
    same = ["Café 5 kW 20 °C Ωmm-1", "Café 5 kW 20 ℃ Ωmm‑1", "Саfé 5 ㎾ 20 °С Ω㎜-1", "Ｃａｆé ５ kW 20 °C Ωmm-1", "Ca​fé 5 k­W 20 °C Ωmm-1"]
    assert pairs(rows(spark, *same)) == list(itertools.combinations(range(5), 2))


def test_other_look(spark):
    other = ["m2", "m²", "M2", "m3", "m 2", "m  2", "Cafe", "Café", "I", "l", "1", "O", "0", "ö", "o", "⽤", "甩", "a.b", "a,b", "−", "—"]
    assert pairs(rows(spark, *other)) == []


def test_radicals_and_ligatures(spark):
    assert pairs(rows(spark, "⽤⽓量", "用气量", "ﬁlter", "filter", "ﬂange", "flange")) == [(0, 1), (2, 3), (4, 5)]


def test_edges(spark):
    df = rows(spark, None, "", " ", " ", "A", "A", "Ａ").unionByName(rows(spark, "Ａ", document=None)).unionByName(rows(spark, "Ａ", document="e"))
    assert pairs(df) == [(4, 6), (5, 6)]
    assert pairs(df.where("false")) == []
    canonical = sorted((r.row_id, r.canonical) for r in lookalikes.canonical_texts(rows(spark, "A", "Ａ", None, "b")).collect())
    assert canonical == [(0, "A"), (1, "A"), (2, None), (3, "b")]


def test_long_and_hot(spark):
    long = "x" * 200_000
    many = [long, long + "​"] + ["plain"] * 300 + ["рlain"]
    got = pairs(rows(spark, *many))
    assert (0, 1) in got and len(got) == 301


def test_mapping_keeps_plain_text():
    table = lookalikes.mapping()
    assert not any(c.isascii() for c in table) and all(unicodedata.category(c) != "No" for c in table)
