import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tabdelta.sources import worksheets
from tabdelta.sources.workbook import parse_book, read_workbook
from tabdelta.sources.worksheets import cells, cut, facts, pieces

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def package(path, sheets, strings=None):
    """An xlsx file; ``sheets``: name -> worksheet XML."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        listed = "".join(f'<sheet name="{n}" r:id="r{k}"{" state=\"hidden\"" if n == "Gone" else ""}/>' for k, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="{REL}"><sheets>{listed}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>' for k in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/styles.xml", f"<styleSheet {NS}><fonts><font/><font><b/></font></fonts><cellXfs><xf/><xf fontId=\"1\"/><xf numFmtId=\"14\"/></cellXfs></styleSheet>")
        if strings is not None:
            z.writestr("xl/sharedStrings.xml", strings)
        for k, body in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{k}.xml", body)


@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 20])
def test_pieces_end_between_rows_and_count_on(monkeypatch, chunk):
    monkeypatch.setattr(worksheets, "CHUNK", chunk)
    for p in ("", "x:"):
        rows = [f"<{p}row><{p}c><{p}v>1</{p}v></{p}c></{p}row>", f'<{p}row spans="1:2" r="5"/>', f'<{p}row z:r="9" ><{p}c/></{p}row>', f"<{p}row/>", f"<{p}row r='20'></{p}row >"]
        whole = f"<{p}worksheet><{p}cols/><{p}rowBreaks/>" + "".join(rows) + f"<{p}mergeCells/></{p}worksheet>"
        got = list(cut(io.BytesIO(whole.encode()), "row"))
        assert b"".join(x[3] for x in got).decode() == whole
        assert (got[0][0], got[-1][0]) == ("head", "tail") and got[-1][1] == 20
        assert {x[2] for x in got} == {f"<{p}worksheet>".encode()}
        starts = [0, 1, 5, 6, 7]  # the row before each row
        at = 0
        for kind, before, _, body in got[1:-1]:
            assert kind == "row" and before == starts[at]
            at += body.decode().count(f"<{p}row")
    assert [x[0] for x in cut(io.BytesIO(b"<worksheet><sheetData/></worksheet>"), "row")] == ["head"]
    one = b"<?xml version='1.0'?><worksheet><sheetData><row><c/></row></sheetData></worksheet>"
    assert [(x[0], x[3]) for x in cut(io.BytesIO(one), "row")] == [("head", one[:43]), ("row", b"<row><c/></row>"), ("tail", b"</sheetData></worksheet>")]
    assert list(cut(io.BytesIO(b""), "row")) == [("head", 0, b"", b"")]


def test_utf16(monkeypatch):
    monkeypatch.setattr(worksheets, "CHUNK", 11)
    got = list(cut(io.BytesIO('<?xml version="1.0"?><sst><si><t>é</t></si><si/></sst>'.encode("utf-16")), "si"))
    assert "".join(x[3].decode() for x in got).endswith("<si><t>é</t></si><si/></sst>")


STRINGS = f'<sst {NS}><si><t>ID</t></si><si><r><t>Na</t></r><r><t>me</t></r><rPh><t>xx</t></rPh></si><si><t xml:space="preserve"> a &lt; b </t></si><si/></sst>'
ODD = (
    f'<worksheet {NS} xmlns:q="urn:q"><cols><col min="2" max="3" hidden="1"/><col min="4" max="4"/></cols><sheetData><row q:s="1"><c t="s" s="1"><v>0</v></c><c t="inlineStr"><is><t>Gone</t></is></c><c r="D1" t="s" s="1"><v>1</v></c></row>'
    '<row r="4"><c r="A4"><f>1+1</f><v>2</v></c><c r="D4" t="s"><v>2</v></c></row><row/><row><c><v>45292</v></c><c s="2"><v>45292</v></c><c t="b"><v>0</v></c><c t="s"><v>3</v></c><c t="e"><v>#N/A</v></c></row></sheetData>'
    '<mergeCells><mergeCell ref="A1:B1"/><mergeCell ref="C7"/></mergeCells></worksheet>'
)


def as_parsed(data):
    book = parse_book(data, "xlsx")
    grid = {(s.name, r, c, *v) for s in book for (r, c), v in s.cells.items()}
    side = {(s.name, "hidden", c) for s in book for c in s.hidden_columns} | {(s.name, "merge", m) for s in book for m in s.merges} | {(s.name, "visible", s.visible) for s in book}
    return grid, side


def as_read(spark, path):
    found = pieces(spark, path)
    grid = [tuple(r)[1:] for r in cells(found).collect()]
    side = set()
    for f in facts(found).collect():
        if f.fact == "hidden":
            side |= {(f.sheet, "hidden", c) for c in range(f.first_col, f.last_col + 1)}
        else:
            side.add((f.sheet, "merge", (f.first_row, f.last_row, f.first_col, f.last_col)) if f.fact == "merge" else (f.sheet, "visible", f.visible))
    assert len(grid) == len(set(grid))
    return set(grid), side


def test_equal_to_the_reader_of_one_task(spark, tmp_path):
    path = str(tmp_path / "odd.xlsx")
    package(path, {"Main": ODD, "Gone": ODD, "Empty": f"<worksheet {NS}><sheetData/></worksheet>"}, STRINGS)
    with open(path, "rb") as f:
        want = as_parsed(f.read())
    assert as_read(spark, path) == want
    tables, rows = read_workbook(spark, path)
    assert list(tables) == ["Main", "Gone", "Empty"] and rows["Main"] == 0
    assert tables["Main"].columns == ["ID", "Name", "Unnamed_2", "__rid"] and tables["Empty"].columns == ["__rid"] and tables["Empty"].count() == 0
    assert [tuple(r) for r in tables["Main"].orderBy("__rid").collect()] == [("2", " a < b ", None, 3), ("45292", None, None, 5)]
    assert list(read_workbook(spark, path, sheets="visible", hidden_columns="keep")[0]["Main"].columns)[:3] == ["ID", "Gone", "Unnamed_2"]


def test_a_long_sheet_is_read_by_several_tasks(spark, tmp_path):
    n, path = 120_000, str(tmp_path / "long.xlsx")
    line = lambda k: f'<row r="{k + 2}"><c r="A{k + 2}"><v>{k}</v></c><c r="B{k + 2}" t="s"><v>{k % 3 if k % 4 else 2}</v></c><c r="C{k + 2}" t="inlineStr"><is><t>n{k % 1000}</t></is></c></row>'
    head = '<row r="1"><c r="A1" t="inlineStr"><is><t>ID</t></is></c><c r="B1" t="inlineStr"><is><t>Word</t></is></c><c r="C1" t="inlineStr"><is><t>Name</t></is></c></row>'
    package(path, {"Long": f"<worksheet {NS}><sheetData>{head}{''.join(map(line, range(n)))}</sheetData></worksheet>"}, f"<sst {NS}><si><t>a</t></si><si><t>b</t></si><si><t>hot</t></si></sst>")
    parts = pieces(spark, path).where("kind = 'row'")
    per_task = [r.n for r in parts.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(per_task) > 2 and max(per_task) < sum(per_task)
    df = read_workbook(spark, path)[0]["Long"]
    k = F.col("ID").cast("long")
    right = (F.col("__rid") == k + 1) & (F.col("Word") == F.when(k % 4 == 0, "hot").otherwise(F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("hot")), (k % 3 + 1).cast("int")))) & (F.col("Name") == F.concat(F.lit("n"), (k % 1000).cast("string")))
    assert df.where(right).count() == df.count() == n and df.select("ID").distinct().count() == n
