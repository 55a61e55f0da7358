"""Workbooks (xlsx, xlsm, ods) from their zipped XML, without third-party packages.

``read_grids`` reads any number of files of any store into one long grid, a task per
file; the bytes come through Spark's binaryFile scan. A Python Data Source does the
same for one file, a sheet per partition; its workers have no session, so it opens the
file as a local path or through Arrow's file systems (file, hdfs, s3, gs, abfs).
Legacy xls and encrypted files need a decoder the caller registers; without one
they are an error, never an empty workbook.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree as ET

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.names import extension, header_index, unique_names
from ..functions.normalize import missing_words
from ..plans.headers import ROWS_NEEDED, Styles, effective_rows, header_row
from .delimited import head

_OLE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"

GRID = T.StructType([T.StructField("sheet", T.StringType()), T.StructField("row_idx", T.IntegerType()), T.StructField("col_idx", T.IntegerType()), T.StructField("value", T.StringType()), T.StructField("is_string", T.BooleanType()), T.StructField("bold", T.BooleanType())])

#: Decoders by name: ``decrypt`` (bytes, password) -> bytes and ``xls`` (bytes) -> list of Sheet.
DECODERS: dict[str, Callable] = {}


@dataclass
class Sheet:
    name: str
    visible: bool = True
    cells: dict[tuple[int, int], tuple[str, bool, bool]] = field(default_factory=dict)  # (row, col) -> value, is text, bold
    merges: list[tuple[int, int, int, int]] = field(default_factory=list)
    hidden_columns: set[int] = field(default_factory=set)

    def width(self) -> int:
        return max((c for _, c in self.cells), default=-1) + 1

    def grid(self, rows: int) -> list[list]:
        """The first rows as typed cells: text as str, anything else as float or its text."""
        width, out = self.width(), []
        last = max((r for r, _ in self.cells), default=-1)
        for r in range(min(rows, last + 1)):
            line = []
            for c in range(width):
                got = self.cells.get((r, c))
                if got is None:
                    line.append(None)
                elif got[1]:
                    line.append(got[0])
                else:
                    try:
                        line.append(float(got[0]))
                    except ValueError:
                        line.append(got[0])
            out.append(line)
        return out

    def styles(self) -> Styles:
        return Styles({k for k, v in self.cells.items() if v[2]}, self.merges)


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref).group():
        n = n * 26 + ord(ch) - 64
    return n - 1


def number_text(raw: str) -> str:
    """A number as a spreadsheet reader shows it: whole values without a fraction."""
    try:
        x = float(raw)
    except ValueError:
        return raw
    return str(int(x)) if x == int(x) and abs(x) < 1 << 53 else repr(x)


def _date_text(raw: str) -> str:
    import datetime

    moment = datetime.datetime(1899, 12, 30) + datetime.timedelta(days=float(raw))
    return moment.strftime("%Y-%m-%d %H:%M:%S")


def open_book(data: bytes, password: str | None = None) -> bytes:
    """Bytes of a readable workbook; encrypted ones go to the registered decoder."""
    if not data.startswith(_OLE):
        return data
    if "decrypt" in DECODERS and password is not None:
        return DECODERS["decrypt"](data, password)
    raise ValueError("an encrypted or legacy workbook: register DECODERS['decrypt'] and give a password, or DECODERS['xls']")


def parse_book(data: bytes, ext: str, password: str | None = None, max_rows: int | None = None, only: str | None = None, styled: bool = True) -> list[Sheet]:
    """The sheets of a workbook, or the one named ``only``; without ``styled`` fonts and number formats aren't read."""
    if ext == "xls" and data.startswith(_OLE) and "xls" in DECODERS:
        return DECODERS["xls"](data)
    data = open_book(data, password)
    if ext == "xls" and not data.startswith(b"PK"):
        raise ValueError("legacy xls needs DECODERS['xls']")
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return [s for s in (_ods(z, max_rows) if ext == "ods" else _xlsx(z, max_rows, only, styled)) if only in (None, s.name)]


def sheet_members(z: zipfile.ZipFile) -> Iterator[tuple[str, bool, str]]:
    """(name, visible, member of the package) of the sheets of an xlsx workbook, in their order."""
    relations = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    for s in ET.fromstring(z.read("xl/workbook.xml")).iter():
        if _local(s.tag) == "sheet":
            target = relations[next(v for k, v in s.attrib.items() if _local(k) == "id")].lstrip("/")
            yield s.get("name"), s.get("state", "visible") == "visible", target if target.startswith("xl/") else f"xl/{target}"


def string_text(item: ET.Element) -> str:
    """The text of a string item or an inline string: plain or in runs, without its phonetic reading."""
    runs = [item, *(x for x in item if _local(x.tag) == "r")]
    return "".join(t.text or "" for x in runs for t in x if _local(t.tag) == "t")


def _xlsx(z: zipfile.ZipFile, max_rows: int | None, only: str | None, styled: bool) -> Iterator[Sheet]:
    strings = []
    if "xl/sharedStrings.xml" in z.namelist():
        strings = [string_text(x) for x in ET.fromstring(z.read("xl/sharedStrings.xml")) if _local(x.tag) == "si"]
    bold, dates = styles_of(z, styled)
    for name, visible, member in sheet_members(z):
        if only in (None, name):
            sheet = Sheet(name, visible)
            with z.open(member) as f:
                _xlsx_sheet(f, sheet, strings, bold, dates, max_rows)
            yield sheet


def styles_of(z: zipfile.ZipFile, styled: bool = True) -> tuple[list[bool], list[bool]]:
    """Which cell formats are bold, and which show dates."""
    return _styles(z) if styled and "xl/styles.xml" in z.namelist() else ([], [])


def _styles(z: zipfile.ZipFile) -> tuple[list[bool], list[bool]]:
    root = ET.fromstring(z.read("xl/styles.xml"))
    fonts, formats, bold, dates = [], {}, [], []
    for part in root:
        kind = _local(part.tag)
        if kind == "fonts":
            fonts = [any(_local(x.tag) == "b" and x.get("val", "1") not in ("0", "false") for x in f) for f in part]
        elif kind == "numFmts":
            formats = {int(f.get("numFmtId")): f.get("formatCode", "") for f in part}
        elif kind == "cellXfs":
            for x in part:
                at, code = int(x.get("fontId", 0)), int(x.get("numFmtId", 0))
                bold.append(at < len(fonts) and fonts[at])
                shape = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", formats.get(code, ""))
                dates.append(14 <= code <= 22 or code in (45, 46, 47) or bool(re.search("[dmyhs]", shape, re.I)))
    return bold, dates


def hidden_range(col: ET.Element) -> range:
    """The columns that a ``col`` element hides."""
    return range(int(col.get("min")) - 1, int(col.get("max"))) if col.get("hidden") in ("1", "true") else range(0)


def merged_range(ref: str) -> tuple[int, int, int, int]:
    """First row, last row, first column, last column of a merged range."""
    a, _, b = ref.partition(":")
    line = lambda r: int(re.search(r"\d+", r).group()) - 1
    return line(a), line(b or a), _column(a), _column(b or a)


def row_cells(row: ET.Element, bold, dates) -> Iterator[tuple[int, str, bool, bool, bool]]:
    """(column, value, is text, bold, shared) of the cells of a row; the value of a shared string is its number."""
    at = -1
    for c in row:
        if _local(c.tag) != "c":
            continue
        at = _column(c.get("r")) if c.get("r") else at + 1
        style, kind = int(c.get("s", 0)), c.get("t", "n")
        is_bold = style < len(bold) and bool(bold[style])
        raw = next((p.text for p in c if _local(p.tag) == "v"), None)
        if kind == "inlineStr":
            yield at, "".join(string_text(p) for p in c if _local(p.tag) == "is"), True, is_bold, False
        elif raw is None:
            continue
        elif kind == "s":
            yield at, raw, True, is_bold, True
        elif kind == "b":
            yield at, "True" if raw == "1" else "False", False, is_bold, False
        elif kind in ("str", "e", "d"):
            yield at, raw, kind == "str", is_bold, False
        else:
            yield at, _date_text(raw) if style < len(dates) and dates[style] else number_text(raw), False, is_bold, False


def _xlsx_sheet(stream, sheet: Sheet, strings, bold, dates, max_rows) -> None:
    row = -1
    for event, x in ET.iterparse(stream, events=("start", "end")):
        kind = _local(x.tag)
        if event == "start":
            if kind == "row":
                row = int(x.get("r", row + 2)) - 1
            continue
        if kind == "col":
            sheet.hidden_columns.update(hidden_range(x))
        elif kind == "mergeCell":
            sheet.merges.append(merged_range(x.get("ref")))
        elif kind == "row":
            if max_rows is None or row < max_rows:
                for at, value, text, is_bold, shared in row_cells(x, bold, dates):
                    sheet.cells[row, at] = (strings[int(value)] if shared else value, text, is_bold)
            x.clear()


def _ods(z: zipfile.ZipFile, max_rows: int | None) -> Iterator[Sheet]:
    get = lambda x, name: next((v for k, v in x.attrib.items() if _local(k) == name), None)
    root = ET.fromstring(z.read("content.xml"))
    bold_styles, hidden_tables = set(), set()
    for st in root.iter():
        if _local(st.tag) == "style":
            for p in st:
                if get(p, "font-weight") == "bold":
                    bold_styles.add(get(st, "name"))
                if _local(p.tag) == "table-properties" and get(p, "display") == "false":
                    hidden_tables.add(get(st, "name"))
    for t in root.iter():
        if _local(t.tag) != "table":
            continue
        sheet, row, at = Sheet(get(t, "name"), get(t, "style-name") not in hidden_tables), 0, 0
        for x in t.iter():
            kind = _local(x.tag)
            if kind == "table-column":
                n = int(get(x, "number-columns-repeated") or 1)
                if get(x, "visibility") in ("collapse", "filter"):
                    sheet.hidden_columns.update(range(at, at + n))
                at += n
            elif kind == "table-row":
                times, col, line = int(get(x, "number-rows-repeated") or 1), 0, []
                for c in x:
                    if _local(c.tag) not in ("table-cell", "covered-table-cell"):
                        continue
                    n = int(get(c, "number-columns-repeated") or 1)
                    of = get(c, "value-type")
                    if of in ("float", "currency", "percentage"):
                        value = (number_text(get(c, "value")), False)
                    elif of == "date":
                        value = (get(c, "date-value").replace("T", " "), False)
                    elif of == "boolean":
                        value = (get(c, "boolean-value").capitalize(), False)
                    elif of:
                        value = ("\n".join("".join(p.itertext()) for p in c if _local(p.tag) == "p"), True)
                    else:
                        value = None
                    down, across = int(get(c, "number-rows-spanned") or 1), int(get(c, "number-columns-spanned") or 1)
                    if down > 1 or across > 1:
                        sheet.merges.append((row, row + down - 1, col, col + across - 1))
                    if value is not None:
                        line += [(col + k, (*value, get(c, "style-name") in bold_styles)) for k in range(n)]
                    col += n
                for k in range(times if line else 0):
                    if max_rows is None or row + k < max_rows:
                        for c, v in line:
                            sheet.cells[row + k, c] = v
                row += times
        yield sheet


def _bytes(spark: SparkSession, path: str) -> bytes:
    """One workbook's bytes, through Spark's own file access."""
    row = spark.read.format("binaryFile").load(path).select("content").first()
    if row is None:
        raise FileNotFoundError(path)
    return bytes(row.content)


def _open(path: str) -> bytes:
    """One workbook's bytes without a session: a plain local path, or a URI that Arrow's file systems know."""
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path):
        with open(path, "rb") as f:
            return f.read()
    store, inner = pyarrow.fs.FileSystem.from_uri(path)
    with store.open_input_stream(inner, compression=None) as f:
        return f.read()


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format('workbook_grid').option('path', ..)`` available: the long grid, a sheet per partition."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class SheetPartition(InputPartition):
        def __init__(self, name):
            self.name = name

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.path, self.password = options["path"], options.get("password")
            self.max_rows = int(options["maxRows"]) if "maxRows" in options else None
            self.visible = options.get("sheets", "all") == "visible"

        def _read(self, max_rows, only=None):
            return parse_book(_open(self.path), extension(self.path), self.password, max_rows, only)

        def partitions(self):
            return [SheetPartition(s.name) for s in self._read(1) if s.visible or not self.visible]

        def read(self, partition):
            for s in self._read(self.max_rows, partition.name):
                for (r, c), (value, text, bold) in sorted(s.cells.items()):
                    yield s.name, r, c, value, text, bold

    class WorkbookGrid(DataSource):
        @classmethod
        def name(cls):
            return "workbook_grid"

        def schema(self):
            return GRID

        def reader(self, schema):
            return Reader(self.options)

    spark.dataSource.register(WorkbookGrid)


def read_grids(spark: SparkSession, glob: str, visible: bool = False, password: str | None = None, max_rows: int | None = None) -> DataFrame:
    """The long grid of every workbook that matches, with its path; a file is parsed by one task, wherever it lies."""
    files = spark.read.format("binaryFile").load(glob).select("path", "content")
    schema = T.StructType([T.StructField("path", T.StringType()), *GRID])

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                for s in parse_book(content.as_py(), extension(path), password, max_rows):
                    rows = [(path, s.name, r, c, *v) for (r, c), v in sorted(s.cells.items())] if s.visible or not visible else []
                    for lo in range(0, len(rows), 50_000):
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[lo : lo + 50_000]), (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()))], names=schema.names)

    return files.mapInArrow(run, schema)


def catalog(spark: SparkSession, path: str, keys=(), password: str | None = None, semantics: str = "v2") -> dict[str, int]:
    """1-based header rows proposed per sheet, from the first rows alone."""
    book = parse_book(_bytes(spark, path), extension(path), password, ROWS_NEEDED)
    return {s.name: header_row(s.grid(ROWS_NEEDED), keys, styles=s.styles(), semantics=semantics) + 1 for s in book}


def read_workbook(spark: SparkSession, path: str, keys=(), sheets: str = "all", hidden_columns: str = "drop", header_overrides: dict[str, int] | None = None, password: str | None = None, semantics: str = "v2", on_error: str = "raise") -> tuple[dict[str, DataFrame], dict[str, int]]:
    """({sheet: table of text with __rid}, {sheet: 0-based header row}) of one workbook.

    Overrides are 1-based rows within 1..100. Where the workbook can't be read so, ``on_error='fallback'`` reads it
    once more without styles, with row 0 as header, and returns no header rows.
    """
    effective_rows({}, header_overrides)
    ext = extension(path)
    if ext in ("xlsx", "xlsm") and head(spark, path, len(_OLE)) != _OLE:  # else a decoder registered in this process takes it
        from .worksheets import read_sheets

        try:
            return read_sheets(spark, path, keys, sheets, hidden_columns, header_overrides, password, semantics)
        except Exception:
            if on_error != "fallback":
                raise
            return read_sheets(spark, path, (), sheets, hidden_columns, styled=False, detect=False)[0], {}
    data = _bytes(spark, path)
    hidden = lambda s: sheets == "visible" and not s.visible
    try:
        tables, rows = {}, {}
        for s in parse_book(data, ext, password):
            if hidden(s):
                continue
            given = (header_overrides or {}).get(s.name)
            at = header_index(given) if given else header_row(s.grid(ROWS_NEEDED), keys, styles=s.styles(), semantics=semantics)
            tables[s.name], rows[s.name] = sheet_table(spark, s, at, hidden_columns), at
        return tables, rows
    except Exception:
        if on_error != "fallback":
            raise
        return {s.name: sheet_table(spark, s, 0, hidden_columns) for s in parse_book(data, ext, password, styled=False) if not hidden(s)}, {}


def sheet_table(spark: SparkSession, s: Sheet, header: int, hidden_columns: str = "drop") -> DataFrame:
    width = s.width()
    shown = [c for c in range(width) if hidden_columns == "keep" or c not in s.hidden_columns] or list(range(width))
    last = max((r for r, _ in s.cells), default=-1)
    if header <= last:
        names = unique_names([s.cells[header, c][0] if (header, c) in s.cells else None for c in shown])
    else:
        names = [str(k) for k in range(len(shown))]
    rows = [tuple(s.cells[r, c][0] if (r, c) in s.cells else None for c in shown) + (r,) for r in range(header + 1, last + 1)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField("__rid", T.LongType())])
    df = spark.createDataFrame([r for r in rows if any(v is not None for v in r[:-1])], schema)
    return df.select(*[missing_words(F.col(f"`{n}`")).alias(n) for n in names], "__rid")
