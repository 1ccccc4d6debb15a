import base64

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from docweft.llm import bpe, mixing


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(bpe.default_vocabulary())


@pytest.fixture(scope="module")
def known():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.default_vocabulary(), "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


HARD = ["", " ", "a", "aaaaaaaaaaaaaaaaaaaaaaaa", "  two  spaces\n\n\n", "it's we'll THEY'RE", "数控机床的维护保养" * 5, "é́ ﬁ 👩‍👩‍👧", "\x00\x01", "0123456789" * 9, "<|endoftext|>", "ababababcabab" * 7, "​　x", "x" * 5000, "=-" * 900]


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(codec, known, text):
    assert codec.encode(text) == known.encode_ordinary(text)
    assert codec.decode(codec.encode(text)) == text


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_any_text(codec, known, text):
    text = text.encode("utf-8", "ignore").decode()
    assert codec.encode(text) == known.encode_ordinary(text)
    assert codec.decode(codec.encode(text)) == text


def test_definition(codec):
    for word in ("unbelievably", "ggggg", "控制板"):
        assert codec.part(word.encode()) == codec.merged(word.encode())


def test_caches_may_overflow(codec, known, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PARTS", 2)
    monkeypatch.setattr(bpe, "CACHE_PAIRS", 2)
    text = "The quick brown fox jumped over lazzzzy dogs; undoubtedly"
    assert codec.encode(text) == known.encode_ordinary(text)


def test_documents(spark, known):
    df = spark.createDataFrame([(1, "a b", 7), (2, None, 8), (3, "", 9), (3, "", 9), (None, "x", 0)], "doc_id long, text string, ids int")
    rows = bpe.encode_documents(df).collect()
    assert sorted((r.doc_id or 0, r.ids) for r in rows) == [(0, known.encode_ordinary("x")), (1, known.encode_ordinary("a b")), (2, []), (3, []), (3, [])]
    assert bpe.encode_documents(df.where("false")).count() == 0
    counts = {r.doc_id: (r.n_tokens, r.ids) for r in bpe.count_tokens(df, keep=("ids",)).collect()}
    assert counts[1] == (2, 7) and counts[2] == (0, 8)


SIZES = "doc_id long, source string, n_tokens long, size long, u double"
TARGETS = "source string, target_share double, max_repeats int"


def mixed(spark, sizes, targets, total=None):
    import random

    rng = random.Random(5)
    df = spark.createDataFrame([(i, s, n, n, rng.random()) for i, (s, n) in enumerate(sizes)], SIZES)
    wanted = spark.createDataFrame(targets, TARGETS)
    return mixing.mixture(df, wanted, total), mixing.mixture_report(df, wanted, total)


def test_shares(spark):
    sizes = [("big", 10 + i % 7) for i in range(3000)] + [("small", 11) for _ in range(50)] + [(None, 5), ("other", 5)]
    picked, report = mixed(spark, sizes, [("big", 0.8, 1), ("small", 0.15, 3), ("absent", 0.05, 4)])
    rows = {r.source: r for r in report.collect()}
    total = rows["big"].actual_tokens + rows["small"].actual_tokens
    assert rows["small"].most_copies == 3 and rows["small"].actual_tokens == 50 * 11 * 3
    assert abs(rows["big"].actual_tokens - rows["big"].requested_tokens) <= 16
    assert rows["big"].actual_share == pytest.approx(rows["big"].actual_tokens / total, abs=1e-6)
    assert rows["absent"].actual_tokens == 0 and rows["absent"].missing_tokens == rows["absent"].requested_tokens
    assert picked.groupBy("doc_id").count().where("count > 1").count() == 0


def test_cap_is_reported(spark):
    _, report = mixed(spark, [("a", 10)] * 10 + [("b", 10)] * 10, [("a", 0.9, 2), ("b", 0.1, 2)], total=1000)
    rows = {r.source: r for r in report.collect()}
    assert rows["a"].actual_tokens == 200 and rows["a"].missing_tokens == 700 and rows["b"].actual_tokens == 100


def test_empty_mixture(spark):
    picked, report = mixed(spark, [("x", 1)], [("a", 1.0, 1), (None, 0.5, 1)])
    assert picked.count() == 0 and [r.source for r in report.collect()] == ["a"]


def test_sizes(spark):
    df = spark.createDataFrame([(1, "s", "a b", 1), (2, None, "x", 1), (3, "s", None, 1), (4, "s", "", 1)], "doc_id long, source string, text string, n_tokens int")
    rows = mixing.sized(df).collect()
    assert [(r.doc_id, r.n_tokens) for r in rows] == [(1, 2)] and 0 < rows[0].u < 1


def test_sizes_are_rounded_up(spark):
    rows = mixing.ranked(spark.createDataFrame([(1, 7), (2, 999), (3, 1001), (4, 123456)], "doc_id long, n_tokens long"), 1).collect()
    assert [r["size"] for r in rows] == [7, 999, 1010, 124000]


def test_inclusion_follows_probabilities(spark):
    """Over seeds, documents of each size enter about as often as their own probability says; the largest always do."""
    df = spark.createDataFrame([(i, "a", n) for i, n in enumerate([10] * 300 + [40] * 300 + [160] * 60 + [4000] * 2)], "doc_id long, source string, n_tokens long")
    wanted = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    seeds, hits, expected = 8, {}, {}
    for seed in range(seeds):
        rows = mixing.ranked(df, seed)
        plan = mixing.goals(rows, wanted, 20_000)
        if not expected:
            expected = {r.n_tokens: r.e for r in mixing.planned(rows, plan).groupBy("n_tokens").agg({"p": "avg", "whole": "avg"}).selectExpr("n_tokens", "`avg(p)` + `avg(whole)` AS e").collect()}
        picked = mixing.mixed(rows, plan)
        assert abs(picked.groupBy().sum("n_tokens").first()[0] - 20_000) <= 160
        for r in picked.groupBy("n_tokens").count().collect():
            hits[r.n_tokens] = hits.get(r.n_tokens, 0) + r["count"]
    assert expected[4000] == 1 and expected[40] == pytest.approx(2 * expected[10]) and expected[160] == pytest.approx(4 * expected[10])
    for n, many in ((10, 300), (40, 300), (160, 60), (4000, 2)):
        assert hits[n] / (seeds * many) == pytest.approx(expected[n], rel=0.12)
