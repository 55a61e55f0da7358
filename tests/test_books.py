import os
import zipfile
import zlib

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tabdelta.operators.keyed import KeyedDiff
from tabdelta.sinks.books import fragment, joined_crc, write_books
from tabdelta.sinks.xlsx import write_result
from tabdelta.sources.workbook import parse_book

SCHEMA = "k string, v string, __rid long"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=400), max_size=5))
def test_fragments_are_one_stream(parts):
    crc, data = 0, b""
    for raw, own, packed in map(fragment, parts):
        crc, data = joined_crc(crc, own, raw), data + packed
    assert crc == zlib.crc32(b"".join(parts))
    assert zlib.decompress(data + b"\x03\x00", -15) == b"".join(parts)


def differences(spark):
    old = [(f"k{i}", f"<{i}> & \x01￾'é'", i) for i in range(40)] + [("gone", None, 40), ("null order", "x", None)]
    new = [(f"k{i}", f"new {i}" if i % 2 else None, i) for i in range(30)] + [(f"more{i}", " a\nb ", 50 + i) for i in range(7)]
    return KeyedDiff(spark.createDataFrame(old, SCHEMA), spark.createDataFrame(new, SCHEMA), ["k"]).result()


def contents(paths):
    """Per title the cells (value, and the format's number) of all rows, over the books in order."""
    out = {}
    for path in paths:
        with zipfile.ZipFile(path) as z:
            assert z.testzip() is None
        with open(path, "rb") as f:
            for s in parse_book(f.read(), "xlsx"):
                rows = max((r for r, _ in s.cells), default=0)
                out.setdefault(s.name, []).extend(tuple(s.cells.get((r, c), (None,))[0] for c in range(2)) for r in range(1, rows + 1))
    return out


def test_equal_to_the_workbook_of_the_driver(spark, tmp_path):
    diff, plain = differences(spark), str(tmp_path / "plain.xlsx")
    write_result(diff, ["k", "v"], plain)
    (book,) = write_books(diff, ["k", "v"], str(tmp_path / "one"), "all")
    assert book == {"path": str(tmp_path / "one" / "all.xlsx"), "n_old": 30, "n_new": 30, "n_added": 7, "n_removed": 12}
    assert os.listdir(tmp_path / "one") == ["all.xlsx"]
    mine, theirs = contents([book["path"]]), contents([plain])
    assert list(mine) == list(theirs) and {t: sorted(r, key=str) for t, r in mine.items()} == {t: sorted(r, key=str) for t, r in theirs.items()}
    assert [r[0] for r in mine["Old Values"]] == [f"k{i}" for i in range(30)] == [r[0] for r in mine["New Values"]]  # source order
    assert mine["Removed"][0][0] == "null order" and mine["Removed"][-1][0] == "gone"
    with zipfile.ZipFile(book["path"]) as z:
        assert b's="3"' in z.read("xl/worksheets/sheet2.xml") and b's="4"' in z.read("xl/worksheets/sheet3.xml")


@pytest.mark.parametrize("limit", [2, 5, 11])
def test_books_are_split_at_the_row_limit(spark, tmp_path, limit):
    diff = differences(spark)
    books = write_books(diff, ["k", "v"], str(tmp_path), "part", rows_per_sheet=limit)
    assert all(max(b[c] for c in b if c != "path") <= limit and b["n_old"] == b["n_new"] for b in books)
    assert [os.path.basename(b["path"]) for b in books] == [f"part_{k + 1}.xlsx" for k in range(len(books))]
    got = contents([b["path"] for b in books])
    assert [r[0] for r in got["Old Values"]] == [f"k{i}" for i in range(30)]
    assert sorted(r[0] for r in got["Added"]) == sorted(f"more{i}" for i in range(7)) and len(got["Removed"]) == 12


def test_no_differences_and_no_order(spark, tmp_path):
    diff = differences(spark)
    (book,) = write_books(diff.where("false"), ["k", "v"], str(tmp_path / "none"))
    assert book["n_old"] == 0 and all(not rows for rows in contents([book["path"]]).values())
    (book,) = write_books(diff.drop("rid"), ["k", "v"], str(tmp_path / "free"), order=None)
    assert book["n_old"] == 30 and len(contents([book["path"]])["Removed"]) == 12
    with pytest.raises(ValueError):
        write_books(diff, ["k", "v"], str(tmp_path), rows_per_sheet=1)


def test_a_failed_run_leaves_nothing(spark, tmp_path):
    bad = differences(spark).withColumn("rid", F.when(F.col("status") == "added", F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("rid")))
    with pytest.raises(Exception, match="stop"):
        write_books(bad, ["k", "v"], str(tmp_path / "bad"))
    assert not os.path.isdir(tmp_path / "bad") or os.listdir(tmp_path / "bad") == []
