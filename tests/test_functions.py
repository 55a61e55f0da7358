import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tabdelta.functions import names
from tabdelta.functions.normalize import canonical, canonical_frame, with_canonical

GOLDEN = [
    ("1", "TRUE"), ("1.0", "TRUE"), ("Y", "TRUE"), ("yes", "TRUE"), ("✓", "TRUE"), ("1.00", "1"), ("01", "1"), ("+1", "1"), ("1.", "1"), ("1,0", "1"),
    ("0", "FALSE"), ("0.0", "FALSE"), ("N", "FALSE"), ("X", "FALSE"), ("0.00", "0"), ("-0", "0"), ("123", "123"), ("123.0", "123"), ("1.23e2", "123"),
    ("1,234", "1.234"), ("1,234,567", "1,234,567"), ("1_000", "1000"), ("1D", "1D"), ("1f", "1F"), ("0x1p3", "0X1P3"), ("inf", "INF"), ("1e400", "1E400"),
    ("NAN", "NAN"), ("nan", ""), ("", ""), (None, ""), ("1.0000000001", "1"), ("0.9999999999", "0.9999999999"), ("007", "7"), ("a\n b", "A B"), (" a b ", "A B"), ("   ", ""),
]


def test_golden_canonical_cells(spark):
    df = spark.createDataFrame([(k, v) for k, (v, _) in enumerate(GOLDEN)], "k int, v string")
    both = with_canonical(df, {"a": F.col("v")}).withColumn("b", canonical(F.col("v"))).orderBy("k").collect()
    assert [r.a for r in both] == [w for _, w in GOLDEN]
    assert [r.b for r in both] == [w for _, w in GOLDEN]


def test_large_whole_numbers_collide_like_doubles(spark):
    df = spark.createDataFrame([("9007199254740993",), ("9007199254740992",)], "v string")
    assert with_canonical(df, {"a": F.col("v")}).select("a").distinct().count() == 1


def test_v1_keeps_inner_blanks_and_names_missing_cells(spark):
    df = spark.createDataFrame([("a\n b",), (None,), ("nan",)], "v string")
    assert [r.a for r in with_canonical(df, {"a": F.col("v")}, "v1").collect()] == ["A\n B", "NAN", "NAN"]


def test_empty_frame_keeps_columns(spark):
    df = spark.createDataFrame([], "a string, b string")
    assert canonical_frame(df).columns == ["a", "b"]


def test_names():
    assert names.plain_name(" Employee-Name 1 ") == "employeename1"
    assert names.match_name("Total_Amount_1.2") == "totalamount"
    assert names.match_name("Total_Amount_1.2", "v1") == "totalamount12"
    assert names.key_name("ID_1") == "id" and names.key_name("ID_1", "v1") == "id1"
    assert names.comparable("Report_2024.xlsx") == "report_2024" and names.comparable("Report_2024.xlsx", True) == "report"
    assert names.similarity("diet", "tide") == 0.5 and names.similarity("tide", "diet") == 0.25
    assert names.parse_keys(" a, ,b ") == ["a", "b"]
    assert names.sheet_name("/x/y/Book.one.csv") == "Book.one"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.sampled_from(["A", "A_1", "A_2", "b", " b ", "", "nan", "Unnamed_0"])), max_size=9))
def test_unique_names_are_unique(given_names):
    out = names.unique_names(given_names)
    assert len(out) == len(set(out)) == len(given_names)


def test_bad_semantics(spark):
    with pytest.raises(ValueError):
        with_canonical(spark.createDataFrame([("a",)], "v string"), {"a": F.col("v")}, "v3")
