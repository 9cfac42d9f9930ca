import pytest

from vectrail.operators.packed import packed_values, unpack

CASES = [
    ('"ZU16 \\"long\\" form";FU42', ['ZU16 "long" form', "FU42"]), ('"Du7 ""long"" form" QY10', ['Du7 "long" form', "QY10"]),
    ("['A', 'B_c']", ["A", "B_c"]), ('"BE28 3\' end"；ZK518.13', ["BE28 3' end", "ZK518.13"]), (" a;;b , c-1.2", ["a", "b", "c-1.2"]),
    ("\"donor 'A' flag\",x", ["donor 'A' flag", "x"]), ('"x" "y"', ["x", "y"]), ('"""a"""', ['"a"']), (None, None), ("", []), ("  ", []),
    ('"unclosed; b', ["unclosed", "b"]), ('"a""b","c"', ['a"b', "c"]), ('""', []), ("x;x;x", ["x", "x", "x"]), ("a、b·c", ["a", "b", "c"]),
]


@pytest.mark.parametrize("text, want", CASES)
def test_values(spark, text, want):
    df = spark.createDataFrame([(text,)], "f string")
    assert df.select(packed_values("f").alias("v")).first().v == want


def test_underscore_parts_labels(spark):
    df = spark.createDataFrame([("A1_B2 ",)], "f string")
    assert df.select(packed_values("f", underscore=False).alias("v")).first().v == ["A1", "B2"]


def test_unpack_with_clashing_columns_and_long_text(spark):
    rows = [(1, "a;b", "pos", "x"), (2, None, None, None), (None, "c", "", ""), (3, ";".join(f"g{i}" for i in range(20000)), "", "")]
    got = unpack(spark.createDataFrame(rows, "k long, f string, pos string, piece string"), "k", "f", "t").collect()
    assert {(r.row_id, r.pos, r.piece) for r in got if r.row_id != 3} == {(1, 0, "a"), (1, 1, "b"), (None, 0, "c")}
    assert sum(r.row_id == 3 for r in got) == 20000
    assert unpack(spark.createDataFrame([], "k long, f string"), "k", "f", "t").count() == 0


def test_long_fields_are_whole(spark):
    import time

    text = ", ".join(f'"v,{i}"' if i % 3 == 0 else f"w{i}" for i in range(20_000)) + ", 'it''s \\'odd\\'', last"
    df = spark.createDataFrame([(1, text)], "id long, f string")
    start = time.perf_counter()
    got = [r.piece for r in unpack(df, "id", "f", "t").orderBy("pos").collect()]
    assert got == [f"v,{i}" if i % 3 == 0 else f"w{i}" for i in range(20_000)] + ["it's 'odd'", "last"]
    assert time.perf_counter() - start < 60
