import zipfile

import pytest

from tabdelta.operators.keyed import KeyedDiff
from tabdelta.sinks.xlsx import export_name, write_changes, write_result
from tabdelta.sources import workbook
from tabdelta.sources.delimited import read_delimited, sniff
from tabdelta.sources.workbook import catalog, parse_book, read_workbook, register


def test_sniffing():
    assert sniff(b"a;b\n1;2\n")[1] == ";" and sniff(b"a|b\n1|2\n")[1] == "|"
    assert sniff("é,b\n1,2\n".encode("latin-1"))[0] == "latin-1"
    assert sniff(b"a\tb,c\n", "tsv")[1] == "\t"


def test_delimited_ragged_rows_and_title(spark, tmp_path):
    f = tmp_path / "Staff.csv"
    f.write_bytes("﻿My list\nID,Name,Code\n1,Ann,7\n2,Bob\n\n3,Cy,9,extra\n4,N/A,\"a, b\"\n".encode())
    name, df, at = read_delimited(spark, str(f))
    assert name == "Staff" and at == 1
    rows = [tuple(r[:3]) for r in df.orderBy("__rid").collect()]
    assert df.columns[:3] == ["ID", "Name", "Code"]
    assert rows == [("1", "Ann", "7"), ("2", "Bob", None), ("3", "Cy", "9"), ("4", None, "a, b")]


def test_delimited_keeps_every_column(spark, tmp_path):
    late, wide = tmp_path / "late.csv", tmp_path / "wide.csv"
    late.write_text("ID,v\n" + "1,aaaaaaaaaaaaaaaaaaaa\n" * 60_000 + '2,b,,"x, y"\n')
    _, df, _ = read_delimited(spark, str(late), header=0)
    assert [tuple(r)[:4] for r in df.where("ID = '2'").collect()] == [("2", "b", None, "x, y")]
    wide.write_text(",".join(f"n{k}" for k in range(2100)) + "\n" + ",".join(map(str, range(2100))) + "\n")
    _, df, _ = read_delimited(spark, str(wide), header=0)
    assert len(df.columns) == 2101 and df.select("n2099").first()[0] == "2099"


def test_delimited_encoding_and_long_cells_of_the_whole_file(spark, tmp_path):
    late, wide, broken = tmp_path / "late.csv", tmp_path / "wide.csv", tmp_path / "broken.csv"
    late.write_bytes(b"ID,v\n" + b"1,aaaaaaaaaaaaaaaaaaaa\n" * 60_000 + "2,café\n".encode("latin-1"))
    _, df, _ = read_delimited(spark, str(late), header=0)
    assert df.where("ID = '2'").first().v == "café"
    wide.write_text("ID,v\n1,x\n2," + "y" * 200_000 + '\n3,"' + "z," * 100_000 + '"\n')
    _, df, _ = read_delimited(spark, str(wide), header=0)
    assert df.columns == ["ID", "v", "__rid"] and {r.ID: len(r.v) for r in df.collect()} == {"1": 1, "2": 200_000, "3": 200_000}
    broken.write_text('\n  \nID,v\n1,"a\nb"\n2,"c ""d"", e",f\n')
    _, df, at = read_delimited(spark, str(broken), header=1)
    assert [tuple(r)[:3] for r in df.orderBy("__rid").collect()] == [("1", "a\nb", None), ("2", 'c "d", e', "f")]


def test_delimited_files_are_split(spark, tmp_path):
    f = tmp_path / "big.csv"
    f.write_text("ID,v\n" + "".join(f"{k},{'x' * 90}\n" for k in range(60_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        _, df, _ = read_delimited(spark, str(f))
        assert df.rdd.getNumPartitions() > 3
        ids = [r.ID for r in df.select("ID", "__rid").orderBy("__rid").collect()]
        assert ids == [str(k) for k in range(60_000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_header_overrides_are_held_to_their_bounds(spark, tmp_path):
    path = str(tmp_path / "b.xlsx")
    build(path)
    for row in (0, 101):
        with pytest.raises(ValueError):
            read_workbook(spark, path, header_overrides={"Main": row})


def test_broken_styles_fall_back_to_plain_cells(spark, tmp_path):
    good, bad = str(tmp_path / "b.xlsx"), str(tmp_path / "bad.xlsx")
    build(good)
    with zipfile.ZipFile(good) as a, zipfile.ZipFile(bad, "w") as b:
        for n in a.namelist():
            b.writestr(n, "<broken" if n.endswith("styles.xml") else a.read(n))
    with pytest.raises(Exception):
        read_workbook(spark, bad)
    tables, rows = read_workbook(spark, bad, on_error="fallback")
    assert rows == {} and tables["Main"].count() == 3


def test_grids_of_many_workbooks(spark, tmp_path):
    build(str(tmp_path / "a.xlsx"))
    build(str(tmp_path / "b.xlsx"))
    grid = workbook.read_grids(spark, str(tmp_path / "*.xlsx"), visible=True)
    assert grid.select("path").distinct().count() == 2 and grid.where("bold").count() == 8


def build(path):
    """A workbook with a title, a merged group row, a bold header, a hidden column and a hidden sheet."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda r, v, s=0: f'<c r="{r}" t="inlineStr" s="{s}"><is><t>{v}</t></is></c>'
    body = (
        f'<row r="1">{cell("A1", "Group")}{cell("C1", "Other")}</row><row r="2">{cell("A2", "ID", 1)}{cell("B2", "Secret", 1)}{cell("C2", "Name", 1)}{cell("D2", "Name", 1)}</row>'
        f'<row r="3"><c r="A3"><v>1</v></c>{cell("B3", "s")}{cell("C3", "Ann")}<c r="D3" t="b"><v>1</v></c></row><row r="4"><c r="A4"><v>2.5</v></c>{cell("C4", "Bob")}<c r="D4" s="2"><v>45292</v></c></row>'
    )
    sheet = f'<worksheet {ns}><cols><col min="2" max="2" hidden="1"/></cols><sheetData>{body}</sheetData><mergeCells><mergeCell ref="A1:B1"/></mergeCells></worksheet>'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets><sheet name="Main" r:id="r1"/><sheet name="Gone" state="hidden" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><fonts><font/><font><b/></font></fonts><cellXfs><xf/><xf fontId="1"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)


def test_workbook(spark, tmp_path):
    path = str(tmp_path / "b.xlsx")
    build(path)
    assert catalog(spark, path) == {"Main": 2, "Gone": 2}
    tables, rows = read_workbook(spark, path, sheets="visible")
    assert list(tables) == ["Main"] and rows == {"Main": 1}
    df = tables["Main"]
    assert df.columns == ["ID", "Name", "Name_1", "__rid"]
    assert [tuple(r)[:3] for r in df.orderBy("__rid").collect()] == [("1", "Ann", "True"), ("2.5", "Bob", "2024-01-01 00:00:00")]
    kept, _ = read_workbook(spark, path, hidden_columns="keep", header_overrides={"Main": 1, "Gone": 3})
    assert "Secret" in [r[1] for r in kept["Main"].collect()]


def test_grid_source(spark, tmp_path):
    path = str(tmp_path / "b.xlsx")
    build(path)
    register(spark)
    for name in (path, f"file://{path}", f"file:{path}"):
        grid = spark.read.format("workbook_grid").option("path", name).option("sheets", "visible").load()
        assert grid.where("bold").count() == 4 and grid.select("sheet").distinct().count() == 1


def test_export_name():
    assert export_name(2, "Q1/Q2: sales") == "Pair2_Q1_Q2_ sales_changes.xlsx"


def test_ods(tmp_path):
    path = tmp_path / "b.ods"
    ns = 'xmlns:office="urn:o" xmlns:table="urn:t" xmlns:text="urn:x"'
    cells = '<table:table-row><table:table-cell office:value-type="string"><text:p>ID</text:p></table:table-cell><table:table-cell office:value-type="string"><text:p>V</text:p></table:table-cell></table:table-row><table:table-row table:number-rows-repeated="2"><table:table-cell office:value-type="float" office:value="3.0"/><table:table-cell office:value-type="boolean" office:boolean-value="true"/></table:table-row>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("content.xml", f'<office:document {ns}><table:table table:name="S">{cells}</table:table></office:document>')
    (sheet,) = parse_book(path.read_bytes(), "ods")
    assert sheet.name == "S" and sheet.cells[1, 0][0] == "3" and sheet.cells[2, 1][0] == "True"


def test_encrypted_and_legacy_books_are_errors():
    with pytest.raises(ValueError):
        parse_book(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1rest", "xls")
    workbook.DECODERS["decrypt"] = lambda data, password: (_ for _ in ()).throw(KeyError(password))
    try:
        with pytest.raises(KeyError):
            parse_book(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1rest", "xlsx", "pw")
    finally:
        workbook.DECODERS.clear()


def test_export_reads_back(spark, tmp_path):
    schema = "k string, v string, __rid long"
    old, new = spark.createDataFrame([("a", "1 < 2", 0), ("b", None, 1)], schema), spark.createDataFrame([("a", "9", 0), ("b", "x", 1)], schema)
    changed = KeyedDiff(old, new, ["k"]).result().where("status = 'changed'")
    path = str(tmp_path / "out.xlsx")
    assert write_changes(changed, ["k", "v"], path) == 2
    first, second = parse_book(open(path, "rb").read(), "xlsx")
    assert (first.name, second.name) == ("Old Values", "New Values")
    assert {first.cells[r, 1][0] for r in (1, 2) if (r, 1) in first.cells} == {"1 < 2"}
    assert {second.cells[r, 1][0] for r in (1, 2)} == {"9", "x"}


def test_whole_result_as_a_workbook(spark, tmp_path):
    schema = "k string, v string, __rid long"
    old = spark.createDataFrame([("a", "1", 0), ("b", "2", 1), ("d", None, 2)], schema)
    new = spark.createDataFrame([("a", "9", 0), ("c", "3", 1)], schema)
    path = str(tmp_path / "all.xlsx")
    assert write_result(KeyedDiff(old, new, ["k"]).result(), ["k", "v"], path) == {"changed": 1, "added": 1, "removed": 2}
    book = {s.name: s for s in parse_book(open(path, "rb").read(), "xlsx")}
    assert list(book) == ["Old Values", "New Values", "Added", "Removed"]
    assert book["Added"].cells[1, 0][0] == "c" and {book["Removed"].cells[r, 0][0] for r in (1, 2)} == {"b", "d"}
