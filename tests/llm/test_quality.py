import random

import pytest

from docweft.llm import quality

COMMON = ["the", "of", "and", "is", "的", "在"]
SCHEMA = "doc_id long, text string, words int, form string"


def forms(spark, *texts):
    df = spark.createDataFrame([(i, t, 0, "") for i, t in enumerate(texts)], SCHEMA)
    return {r.doc_id: r for r in quality.document_statistics(df, COMMON).collect()}


PROSE = "The pump is made of steel and the valve is closed. Its housing is sealed and carries the load of the shaft.\n"


def test_forms(spark):
    texts = [
        PROSE * 3, "- pump\n- valve\n- gasket\n- bolt", "a\tb\tc\n1\t2\t3\n4\t5\t6", "| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 | - |", "■□" * 80, "Home > Top > Share > Home > Login > Top > Share", "dmhwmx xzhpxl gobtrs izodzst vprszg jgixcg qndqhx", "泵\n阀门 × 2\n螺栓 × 8\n垫片",
        "x " * 90, "å®\x89è£…è¯´æ˜Žä¹¦ç”µæº" * 6, "Overview\n" + PROSE + "Weight: 5 kg\n" + PROSE, "在控制板的检查之前，应先断开电源。安装支架由耐磨材料制成，在正常条件下能够保护网络连接。", "在控制板的检查之前,应先断开电源,并确认安全。\n外壳由耐磨材料制成,对冷凝水良好,因此不需要防护。", "a,b,c\n1,2,3\n4,5,6", "■-0]>+�@■e…§}<3#   %…+<�|·□0{3-¤3q>3^§…e@~&[@*·¤†#<", None, "", " \n ",
    ]
    got = forms(spark, *texts)
    assert [got[i].form for i in range(len(texts))] == ["prose", "list", "table", "table", "junk", "junk", "junk", "list", "junk", "junk", "prose", "prose", "prose", "table", "junk", None, None, None]
    assert got[15].words == got[16].words == got[17].words == 0 and got[17].common_word_share == 0


def test_counts(spark):
    row = forms(spark, "The pump, 控制 ok.\nEnd of it!\nno end")[0]
    assert (row.words, row.lines) == (10, 3)
    assert row.ended_line_share == pytest.approx(2 / 3, abs=1e-4) and row.common_word_share == pytest.approx(2 / 10)


UNITS = (
    "the pump is on ", "a,", "b;c;", "| x ", "- item ", "\n", "\n\n", "泵阀门控制", " ", "    ", "deadbeef12 ", "QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo=", "Home > Top > ", "首页 » ", "å®\x89è£", "a.", ". ", "。", "xkcdqw vprszg ", "■□", "ab" * 30, "z" * 70,
    "1, 2", "x, y,", "\t", "）", " \r", "|", "aaaaaaa", "我们 ",
)


@pytest.mark.parametrize("chunk", [800, 1001, 3333])
def test_chunks_do_not_show(spark, chunk):
    """No count depends on where chunks are cut, inside of words, lines and repetitions neither."""
    chance = random.Random(chunk)
    texts = [PROSE * 40, "word" * 500 + " " + "泵" * 1000 + ". " + PROSE, "\n" + "ab" * 900 + "\n", "a\n" * 900 + "b." * 900]
    for _ in range(60):
        some = chance.sample(UNITS, chance.randint(1, 6))
        texts.append("".join(chance.choice(some) * chance.choice((1, 1, 2, 10, 40)) for _ in range(chance.choice((60, 200, 500)))))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def counts(chunk):
        rows = quality.summed_counts(quality.chunk_counts(df, ["the", "on", "我们", "的"], "doc_id", "text", chunk))
        return {r["_key"]: r.asDict() for r in rows.collect()}

    assert counts(chunk) == counts(10**7)


def test_repeated_keys_and_empty_table(spark):
    df = spark.createDataFrame([(1, "one two", 0, ""), (1, "three", 0, "")], SCHEMA)
    assert [r.words for r in quality.document_statistics(df, COMMON).collect()] == [3]
    assert quality.document_statistics(df.where("false"), COMMON).count() == 0
    assert quality.document_statistics(df, []).count() == 1


def test_common_words_are_bounded(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("",), ("b",)], "word string")
    assert quality.common_words(df) == ["a", "b"]
    with pytest.raises(ValueError):
        quality.common_words(df, most=1)
    with pytest.raises(ValueError):
        quality.chunk_counts(df, [], "word", "word", chunk=100)
