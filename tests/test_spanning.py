"""Separators, and files whose quoted cells hold line breaks, against Python's csv reader."""

import csv
import io
import random

import pytest
from hypothesis import given, settings, strategies as st

from tabdelta.sources.delimited import file_sizes, read_delimited, sniff
from tabdelta.sources.spanning import SpanningText, ends_inside


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "2k", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def table_of(spark, path, **options):
    _, df, at = read_delimited(spark, str(path), **options)
    return df.columns[:-1], [tuple(r)[:-1] for r in df.orderBy("__rid").collect()], at, df


# -- separators ---------------------------------------------------------------------------------------------
@pytest.mark.parametrize("text, columns, rows", [
    ("name;price\nA;1,5\nB;2,5\n", ["name", "price"], [("A", "1,5"), ("B", "2,5")]),
    ("name;note\nA;one, two, three\nB;x\n", ["name", "note"], [("A", "one, two, three"), ("B", "x")]),
    ("name|price\nA|1,5\nB|2;5\n", ["name", "price"], [("A", "1,5"), ("B", "2;5")]),
    ("name\tprice\nA\t1,5\n", ["name", "price"], [("A", "1,5")]),
    ("\n  \nname;price\nA;1,5\n", ["name", "price"], [("A", "1,5")]),
    ('"a;b";price\nA;1,5\n', ["a;b", "price"], [("A", "1,5")]),
])
def test_the_first_row_tells_the_separator(spark, tmp_path, text, columns, rows):
    f = tmp_path / "t.csv"
    f.write_text(text)
    assert table_of(spark, f, keys=["name", "price"])[:2] == (columns, rows)


def test_a_title_leaves_the_separator_to_most_lines_of_the_whole_file(spark, tmp_path):
    f = tmp_path / "t.csv"
    f.write_text("Prices of the year\nname;price\n" + "".join(f"n{k};{k},5\n" if k % 3 else f"n{k};{k}\n" for k in range(60_000)))
    columns, rows, at, _ = table_of(spark, f)
    assert columns == ["name", "price"] and at == 1 and len(rows) == 60_000
    assert sniff(b"Title\na;b\n1,5;2\n1,5;2,5\n")[1] == ";"


def test_a_tab_file_of_one_column_stays_one(spark, tmp_path):
    f = tmp_path / "t.csv"
    f.write_text("name\nA\nB\n")
    assert table_of(spark, f, header=0)[:2] == (["name"], [("A",), ("B",)])


# -- quoted line breaks -------------------------------------------------------------------------------------
@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.sampled_from(list('"",;ab \r')), max_size=14), st.booleans())
def test_states_are_those_of_the_csv_reader(line, inside):
    """A line ends inside a cell exactly if the reader goes on with the next line."""
    text = ('"' if inside else "") + line + "\nnext"
    rows = list(csv.reader(io.StringIO(text, newline="")))
    assert ends_inside(line.encode(), inside, ord(",")) == (rows[-1] != ["next"])


def odd_table(seed, n):
    rnd = random.Random(seed)
    cell = lambda: rnd.choice(["", "x", "a,b", 'q"q', "line\nbreak", "crlf\r\nbreak", '"', '""', "é€😀", "y" * rnd.randint(0, 60), "\n\n", 'many\n"lines"\nhere,\n' * rnd.randint(1, 4), " pad "])
    return [[str(k), *(cell() for _ in range(rnd.choice([2, 2, 2, 1, 3])))] for k in range(n)]


def expected(text, width):
    rows = [r for r in csv.reader(io.StringIO(text, newline="")) if r][1:]
    return [tuple((c if c != "" else None) for c in r + [""] * (width - len(r))) for r in rows]


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
@pytest.mark.parametrize("literal", [False, True])
def test_rows_equal_the_csv_reader_over_many_splits(spark, tmp_path, small_splits, end, literal):
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=end).writerows([["id", "v", "w"], *odd_table(7, 600)])
    text = out.getvalue()
    if literal:  # quotes that open nothing, text after a closing quote, and a quote left open at the end
        text += end.join(['9001,5" pipe,x', '9002,"a"b,c', '9003, "x",y', '9004,"open'])
    f = tmp_path / "t.csv"
    f.write_bytes(text.encode())
    columns, rows, _, df = table_of(spark, f, header=0)
    assert columns == ["id", "v", "w", "Unnamed_3"] and rows == expected(text, 4)
    assert df.rdd.getNumPartitions() > 4


def test_a_cell_longer_than_several_splits(spark, tmp_path, small_splits):
    text = 'id,v\n1,x\n2,"' + "line of text\n" * 2000 + '"\n3,"a\nb"\n4,"' + "no break " * 2000 + '"\n5,z\n'
    f = tmp_path / "t.csv"
    f.write_text(text)
    _, rows, _, df = table_of(spark, f, header=0)
    assert rows == expected(text, 2) and df.rdd.getNumPartitions() > 4


def test_wide_rows_other_encodings_and_byte_order_marks(spark, tmp_path, small_splits):
    wide, latin, marked = tmp_path / "wide.csv", tmp_path / "latin.csv", tmp_path / "marked.csv"
    wide.write_text('id,v\n1,"a\nb"\n2,' + ",".join(["x"] * 30_000) + "\n")
    rows, width = SpanningText(spark, str(wide), ",", "utf-8", file_sizes(spark, str(wide))).rows()
    assert width == 30_001 and rows.count() == 3  # more cells than a row may have for Spark's own reader by default
    latin.write_bytes('id,v\n1,"é\nü"\n'.encode("latin-1") * 400)
    assert table_of(spark, latin, header=0)[1][0] == ("1", "é\nü")
    marked.write_bytes('"id",v\n1,"a\nb"\n'.encode("utf-8-sig"))
    assert table_of(spark, marked, header=0)[:2] == (["id", "v"], [("1", "a\nb")])


def test_header_is_found_below_a_title_with_line_breaks(spark, tmp_path):
    f = tmp_path / "t.csv"
    f.write_text('"My\nlong\ntitle",\nID,Name\n1,"Ann\nB"\n2,Bob\n')
    columns, rows, at, _ = table_of(spark, f, keys=["ID"])
    assert columns == ["ID", "Name"] and at == 1 and rows == [("1", "Ann\nB"), ("2", "Bob")]
    assert table_of(spark, f, header=50)[1] == []


def test_a_folder_of_files_counts_as_one(spark, tmp_path, small_splits):
    parts = [odd_table(seed, 150) for seed in range(3)]
    for k, rows in enumerate(parts):
        with open(tmp_path / f"part-{k}.csv", "w", newline="") as f:
            csv.writer(f).writerows(rows)
    (tmp_path / "_SUCCESS").write_text("")
    _, rows, at, _ = table_of(spark, tmp_path, columns=["id", "v", "w", "x"])
    assert at == -1 and rows == [tuple(c if c != "" else None for c in r + [""] * (4 - len(r))) for p in parts for r in p]


def test_quoted_files_without_line_breaks_stay_with_sparks_reader(spark, tmp_path):
    f = tmp_path / "t.csv"
    f.write_text('id,v\n' + '1,"a, ""b"""\n' * 50)
    _, rows, _, df = table_of(spark, f, header=0)
    assert set(rows) == {("1", 'a, "b"')}
    assert "MapInArrow" not in df._jdf.queryExecution().toString()
