import pytest
from pyspark.sql import functions as F

from docweft.llm import splitting

PAYLOAD = "item_id long, payload struct<type:string,text:string,rows:array<array<string>>,value_json:string>, start int, pieces string"


def items(spark, *rows):
    return spark.createDataFrame([(i, {"type": t, "text": x, "rows": r, "value_json": v}, 0, "") for i, (t, x, r, v) in enumerate(rows)], PAYLOAD)


def joined(rows, overlap=200):
    rows = sorted(rows, key=lambda r: r.piece_no)
    return rows[0].piece + "".join(r.piece[overlap:] for r in rows[1:])


def test_pieces(spark):
    texts = ["x" * 4000, "x" * 4001, "句子一。" * 1500, ("word " * 50 + ".\n\n") * 60, "", None, "á" * 5000, "😀 sentence ends. " * 900, "\n".join("line %d" % i for i in range(2000))]
    df = items(spark, *[("text", t, None, None) for t in texts], ("table", None, [["a", None], None, ["b" * 3000, "c" * 3000]], None), ("generic", None, None, '{"k":"' + "v" * 9000 + '"}'), ("asset", "z" * 9000, None, None), (None, "z", None, None))
    pieces = splitting.split_contents(df, ["item_id"], splitting.payload_content()).collect()
    by = {}
    for p in sorted(pieces, key=lambda p: p.piece_no):
        by.setdefault(p.item_id, []).append(p)
    contents = {i: t for i, t in enumerate(texts) if t is not None} | {9: "a\t\n\n" + "b" * 3000 + "\t" + "c" * 3000, 10: '{"k":"' + "v" * 9000 + '"}'}
    assert set(by) == set(contents)
    for key, rows in by.items():
        assert joined(rows) == contents[key]
        assert all(r.length == len(r.piece) <= 4000 and contents[key][r.start : r.start + r.length] == r.piece for r in rows)
        assert {r.pieces for r in rows} == {len(rows)} and (len(rows) > 1) == (len(contents[key]) > 4000)
    assert {r.boundary for r in by[3][:-1]} == {"paragraph"} and {r.boundary for r in by[2][:-1]} == {"sentence"} and {r.boundary for r in by[8][:-1]} == {"line"}
    assert not any(r.piece[-1:] == "a" for r in by[6][:-1])  # no letter without its accent
    found = {r.item_id for r in splitting.oversized(df, ["item_id"], splitting.payload_content()).collect()}
    assert found == {k for k, v in contents.items() if len(v) > 4000}


def test_edges(spark):
    df = items(spark, ("text", "y" * 5000, None, None))
    twice = df.unionByName(df)
    assert splitting.split_contents(twice, ["item_id"], splitting.payload_content()).count() == 2 * splitting.split_contents(df, ["item_id"], splitting.payload_content()).count()
    assert splitting.split_contents(df.where("false"), ["item_id"], splitting.payload_content()).count() == 0


@pytest.mark.parametrize("text", ["one line without an end " * 4000, "".join(f"line {i} of 压力变送器\n" for i in range(10_000)), "á" * 30_000, "no" + "b" * 20_000])
def test_ranges_do_not_show(spark, tmp_path, text):
    """The pieces are the same for any size of ranges, of one value and of a file."""
    path = tmp_path / "content.txt"
    path.write_text(text, newline="")
    found = []
    for size in (777, 5000, 1 << 20):
        rows = splitting.split_files(spark, [str(path)], range_bytes=size).drop("path").collect()
        found.append(sorted(tuple(r) for r in rows))
    value = splitting.split_contents(spark.createDataFrame([(1, text)], "k int, t string"), ["k"], F.col("t")).drop("k")
    found.append(sorted(tuple(r) for r in value.collect()))
    assert all(f == found[0] for f in found)
    pieces = [r[-1] for r in found[0]]
    assert pieces[0] + "".join(p[200:] for p in pieces[1:]) == text and max(map(len, pieces)) <= 4000


def test_broken_files(spark, tmp_path):
    (tmp_path / "bad.bin").write_bytes(b"\xff\xfe abc " * 2000)
    rows = splitting.split_files(spark, [str(tmp_path / "bad.bin")], range_bytes=999).collect()
    assert len(rows) > 1 and all(len(r.piece) == r.length for r in rows)
    assert splitting.split_files(spark, []).count() == 0


def test_keys_may_be_named_like_columns(spark):
    df = spark.createDataFrame([(1, 2, 3, "x " * 3000)], "path int, at int, size int, t string")
    rows = splitting.split_contents(df, ["path", "at", "size"], F.col("t")).collect()
    assert len(rows) == 2 and {(r.path, r.at, r["size"]) for r in rows} == {(1, 2, 3)}
    assert splitting.oversized(df, ["path"], F.col("t")).collect()[0].path == 1


def test_other_limits(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma delta " * 40)], "k int, t string")
    rows = splitting.split_contents(df, ["k"], F.col("t"), limit=100, overlap=10, window=30).collect()
    assert max(r.length for r in rows) <= 100 and joined(rows, 10) == "alpha beta gamma delta " * 40


def test_files(spark, tmp_path):
    text = ("Ein Satz über Öl. " * 7 + "\n\n" + "压力变送器安装说明。" * 30 + "\n") * 60
    path = tmp_path / "big.txt"
    path.write_bytes(text.encode())
    (tmp_path / "empty.txt").write_bytes(b"")
    rows = splitting.split_files(spark, [str(path), str(tmp_path / "empty.txt")], limit=1000, overlap=50, window=200, range_bytes=5000).collect()
    assert {r.path for r in rows} == {str(path)}
    rows.sort(key=lambda r: r.piece_no)
    assert all(text[r.start : r.start + r.length] == r.piece and r.length <= 1000 for r in rows)
    assert rows[0].start == 0 and all(b.start == a.start + a.length - 50 for a, b in zip(rows, rows[1:], strict=False)) and rows[-1].start + rows[-1].length == len(text)
    again = splitting.split_files(spark, [str(path)], limit=1000, overlap=50, window=200, range_bytes=50_000).collect()
    assert {r.piece for r in again} == {r.piece for r in rows}  # the ranges don't show
