"""Worksheets of xlsx and xlsm workbooks read by many tasks.

A worksheet is one compressed stream, but inflating it takes a small part of the time
that parsing its XML does. One task per file therefore only inflates and cuts: each
sheet and the shared strings are handed on as pieces of about CHUNK bytes that begin and
end between rows (or strings), with the number of rows (or strings) before the piece,
since rows needn't say their number. The pieces are dealt out and written to the shared
folder; all else is DataFrame work over them: parsing, a join of the cells that hold
shared strings with these, hidden columns and merged ranges.

Memory of a cutting task is the file as stored, a piece, and the longest row. Of a
workbook the driver sees what a schema takes: names of sheets, hidden columns, and the
first rows, from which the header is told.

Rows within comments or CDATA sections, which spreadsheet programs don't write, aren't
told from others. A sheet without rows gives a fact row and no cells; of cells that
repeat a place in a row the last one counts; a number of a shared string that doesn't exist is an
empty text.
"""

from __future__ import annotations

import codecs
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.names import header_index, unique_names
from ..functions.normalize import missing_words
from ..operators.staging import scratch
from ..plans.headers import ROWS_NEEDED, Styles, effective_rows, header_row
from .workbook import _local, hidden_range, merged_range, open_book, row_cells, sheet_members, string_text, styles_of

CHUNK = 1 << 20
_PIECES = pa.schema([("path", pa.string()), ("position", pa.int32()), ("sheet", pa.string()), ("visible", pa.bool_()), ("kind", pa.string()), ("first", pa.int64()), ("root", pa.binary()), ("body", pa.binary()), ("bold", pa.binary()), ("dates", pa.binary())])
_CELL = pa.struct([("col_idx", pa.int32()), ("value", pa.string()), ("is_string", pa.bool_()), ("bold", pa.bool_()), ("shared", pa.int64())])
_ROWS = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("row_idx", pa.int32()), ("piece", pa.int64()), ("line", pa.int32()), ("cells", pa.list_(_CELL))])
_STRINGS = pa.schema([("path", pa.string()), ("shared", pa.int64()), ("text", pa.string())])
_FACTS = pa.schema([("path", pa.string()), ("position", pa.int32()), ("sheet", pa.string()), ("visible", pa.bool_()), ("fact", pa.string()), ("first_row", pa.int32()), ("last_row", pa.int32()), ("first_col", pa.int32()), ("last_col", pa.int32())])
_BATCH = 50_000


def _ddl(schema: pa.Schema) -> str:
    names = {pa.string(): "string", pa.bool_(): "boolean", pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.list_(_CELL): "array<struct<col_idx: int, value: string, is_string: boolean, bold: boolean, shared: long>>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = _BATCH) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), schema.types)], schema=schema)


def _utf8(stream) -> Iterator[bytes]:
    """The stream in UTF-8, whatever of the encodings of XML packages it is in."""
    start = stream.read(CHUNK)
    if start[:2] in (b"\xff\xfe", b"\xfe\xff"):
        decode = codecs.getincrementaldecoder("utf-16")()
        while start:
            yield re.sub(r"^<\?xml.*?\?>", "", decode.decode(start)).encode()
            start = stream.read(CHUNK)
        return
    while start:
        yield start
        start = stream.read(CHUNK)


def cut(stream, tag: str) -> Iterator[tuple[str, int, bytes, bytes]]:
    """(kind, elements before, root tag, bytes) of a document: its head, pieces of whole ``tag`` elements, and its tail.

    The number before a piece of rows is that of the last row before it, counted on where rows don't say theirs.
    """
    prefix = rb"(?:[A-Za-z_][\w.-]*:)?"
    opening = re.compile(rb"<" + prefix + tag.encode() + rb"(?=[\s/>])[^>]*>")
    closing = re.compile(rb"</" + prefix + tag.encode() + rb"\s*>")
    own_number = re.compile(rb"(?<![\w:.-])r\s*=\s*[\"'](\d+)")
    held, root, number = b"", None, 0

    def count(starts):
        n = number
        for x in starts:
            said = own_number.search(x.group()) if tag == "row" else None
            n = int(said.group(1)) if said else n + 1
        return n

    for more in _utf8(stream):
        held += more
        starts = list(opening.finditer(held))
        if not starts:
            continue
        begin, last = starts[0].start(), starts[-1].start()
        if root is None:
            root = _root(held[:begin])
            yield "head", 0, root, held[:begin]
        if len(starts) > 1:  # the last element may go on
            yield tag, number, root, held[begin:last]
            number = count(starts[:-1])
        held = held[last:]
    starts = list(opening.finditer(held))
    if root is None:
        root = _root(held)
        yield "head", 0, root, held
        return
    at = starts[0]
    end = at.end() if at.group().endswith(b"/>") else closing.search(held, at.end()).end()
    yield tag, number, root, held[:end]
    yield "tail", count(starts), root, held[end:]


def _root(head: bytes) -> bytes:
    """The start tag of the document's root, which declares the prefixes that its pieces use."""
    found = re.search(rb"<(?![?!])[^>]*>", head)
    return found.group() if found else b""


def _elements(root: bytes, body: bytes) -> ET.Element:
    return ET.fromstring(root + body + b"</" + re.match(rb"<([^\s/>]+)", root).group(1) + b">")


def pieces(spark: SparkSession, glob: str, password: str | None = None, styled: bool = True) -> DataFrame:
    """Pieces of every workbook that matches, written to the shared folder and dealt out over all tasks."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from _batches(_pieces_of(path, content.as_py(), password, styled), _PIECES, 8)

    files = spark.read.format("binaryFile").load(glob).select("path", "content")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    where = scratch(spark, "worksheets")
    files.mapInArrow(run, _ddl(_PIECES)).repartition(tasks, "path", "position", "first").write.parquet(where, compression="zstd")
    return spark.read.schema(_ddl(_PIECES)).parquet(where)


def _pieces_of(path: str, data: bytes, password: str | None, styled: bool) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(open_book(data, password))) as z:
        bold, dates = (bytes(x) for x in styles_of(z, styled))
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as f:
                for kind, before, root, body in cut(f, "si"):
                    if kind == "si":
                        yield path, -1, None, None, kind, before, root, body, None, None
        for position, (name, visible, member) in enumerate(sheet_members(z)):
            with z.open(member) as f:
                for kind, before, root, body in cut(f, "row"):
                    yield path, position, name, visible, kind, before, root, body, bold if kind == "row" else None, dates if kind == "row" else None


def _parsed(df: DataFrame, columns: tuple[str, ...], schema: pa.Schema, rows, size: int = _BATCH) -> DataFrame:
    """``rows`` of every piece, by its columns."""

    def run(batches):
        yield from _batches((x for b in batches for line in zip(*(c.to_pylist() for c in b.columns)) for x in rows(*line)), schema, size)

    return df.select(*columns).mapInArrow(run, _ddl(schema))


def _rows_of(path, sheet, first, root, body, bold, dates):
    number = first
    for k, row in enumerate(_elements(root, body)):
        number = int(row.get("r", number + 1))
        last = {at: x for at, *x in row_cells(row, bold, dates)}
        if last:
            got = [{"col_idx": at, "value": None if shared else value, "is_string": text, "bold": is_bold, "shared": int(value) if shared else None} for at, (value, text, is_bold, shared) in last.items()]
            yield path, sheet, number - 1, first, k, got


def _strings_of(path, first, root, body):
    for k, item in enumerate(_elements(root, body)):
        yield path, first + k, string_text(item)


def _facts_of(path, position, sheet, visible, kind, body):
    if kind == "head":
        yield path, position, sheet, visible, "sheet", None, None, None, None
        for tag in re.findall(rb"<(?:[A-Za-z_][\w.-]*:)?col(?=\s)[^>]*>", body):
            col = ET.Element("col", {k.decode(): v.decode() for k, v in re.findall(rb"(min|max|hidden)\s*=\s*[\"']([^\"']*)", tag)})
            gone = hidden_range(col)
            if gone:
                yield path, position, sheet, visible, "hidden", None, None, gone.start, gone.stop - 1
    for ref in re.findall(rb"<(?:[A-Za-z_][\w.-]*:)?mergeCell(?=\s)[^>]*?ref\s*=\s*[\"']([A-Z0-9:]+)", body):
        yield path, position, sheet, visible, "merge", *merged_range(ref.decode())


def rows(found: DataFrame) -> DataFrame:
    """(path, sheet, row_idx, cells) of all pieces, cells being structs of col_idx, value, is_string, bold; rows without cells don't count.

    Without shared strings nothing is shuffled. Else cells meet the strings and rows are put together again. Cells without
    a shared string get a key of their own, so they don't meet in one task; a string that many cells share is unique on
    the other side, and adaptive execution splits its cells.
    """
    got = _parsed(found.where("kind = 'row'"), ("path", "sheet", "first", "root", "body", "bold", "dates"), _ROWS, _rows_of, 2_000)
    cell = lambda value: F.struct("col_idx", value.alias("value"), "is_string", "bold")
    if found.where("kind = 'si'").select("kind").isEmpty():
        whole = F.transform("cells", lambda x: F.struct(x.col_idx.alias("col_idx"), x.value.alias("value"), x.is_string.alias("is_string"), x.bold.alias("bold")))
        return got.select("path", "sheet", "row_idx", whole.alias("cells"))
    texts = _parsed(found.where("kind = 'si'"), ("path", "first", "root", "body"), _STRINGS, _strings_of)
    row = ("path", "sheet", "row_idx", "piece", "line")
    single = got.select(*row, F.explode("cells").alias("x")).select(*row, "x.*").withColumn("is_shared", F.col("shared").isNotNull())
    keyed = single.withColumn("shared", F.coalesce("shared", -1 - F.col("row_idx").cast("long")))
    joined = keyed.hint("merge").join(texts, ["path", "shared"], "left")  # merge: the size of the strings isn't known before they are parsed
    value = F.when(F.col("is_shared"), F.coalesce("text", F.lit(""))).otherwise(F.col("value"))
    return joined.groupBy(*row).agg(F.collect_list(cell(value)).alias("cells")).select("path", "sheet", "row_idx", "cells")


def cells(found: DataFrame) -> DataFrame:
    """The long grid of all pieces: path, sheet, row_idx, col_idx, value, is_string, bold."""
    return rows(found).select("path", "sheet", "row_idx", F.explode("cells").alias("x")).select("path", "sheet", "row_idx", "x.*")


def by_column(cells: str = "cells"):
    """Of the cells of a row, a map from column to value."""
    return F.map_from_entries(F.transform(cells, lambda x: F.struct(x.col_idx, x.value)))


def facts(found: DataFrame) -> DataFrame:
    """(path, position, sheet, visible, fact, first_row, last_row, first_col, last_col): a row per sheet, per range of hidden columns and per merged range."""
    return _parsed(found.where("kind IN ('head', 'tail')"), ("path", "position", "sheet", "visible", "kind", "body"), _FACTS, _facts_of)


def first_lines(got: dict[tuple[int, int], tuple], last: int, width: int) -> list[list]:
    """The rows of one sheet from which its header is told (at most ROWS_NEEDED), typed as the driver's rules take them."""
    typed = lambda x: None if x is None else x.value if x.is_string else _number(x.value)
    return [[typed(got.get((r, c))) for c in range(width)] for r in range(min(last + 1, ROWS_NEEDED))]


def _number(value: str):
    try:
        return float(value)
    except ValueError:
        return value


def sheet_table(lines: DataFrame, header: int, names_at: dict[int, str] | None, shown: list[int]) -> DataFrame:
    """The rows below the header as a table of text with __rid, without those that are blank in all columns shown. ``names_at``: the header's cells, None where it is below all rows."""
    names = [str(k) for k in range(len(shown))] if names_at is None else unique_names([names_at.get(c) for c in shown])
    below = lines.where(F.col("row_idx") > header).select("row_idx", by_column().alias("cells"))
    below = below.where(F.arrays_overlap(F.map_keys("cells"), F.array(*map(F.lit, shown)))) if shown else below.where("false")
    return below.select(*[missing_words(F.col("cells")[c]).alias(n) for c, n in zip(shown, names)], F.col("row_idx").cast("long").alias("__rid"))


def read_sheets(spark: SparkSession, path: str, keys=(), sheets: str = "all", hidden_columns: str = "drop", header_overrides: dict[str, int] | None = None, password: str | None = None, semantics: str = "v2", styled: bool = True, detect: bool = True) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """({sheet: table of text with __rid}, {sheet: 0-based header row}) of one xlsx workbook; without ``detect`` row 0 is the header."""
    effective_rows({}, header_overrides)
    found = pieces(spark, path, password, styled)
    where = scratch(spark, "rows")
    rows(found).write.parquet(where)
    lines, about = spark.read.parquet(where), facts(found)
    given = header_overrides or {}
    side = about.where((F.col("fact") != "merge") | (F.col("first_row") < ROWS_NEEDED)).orderBy("position").collect()
    ends = {r.sheet: (r.row, r.col + 1) for r in lines.groupBy("sheet").agg(F.max("row_idx").alias("row"), F.max(F.array_max("cells.col_idx")).alias("col")).collect()}
    top: dict[str, dict] = {}
    for r in lines.where((F.col("row_idx") < ROWS_NEEDED) | F.col("row_idx").isin([header_index(x) for x in given.values()])).collect():
        top.setdefault(r.sheet, {}).update(((r.row_idx, x.col_idx), x) for x in r.cells)
    tables, at_rows = {}, {}
    for s in (x for x in side if x.fact == "sheet" and (sheets != "visible" or x.visible)):
        (last, width), got = ends.get(s.sheet, (-1, 0)), top.get(s.sheet, {})
        mine = [x for x in side if x.position == s.position]
        styles = Styles({at for at, x in got.items() if x.bold}, [(x.first_row, x.last_row, x.first_col, x.last_col) for x in mine if x.fact == "merge"])
        if s.sheet in given:
            at = header_index(given[s.sheet])
        else:
            at = header_row(first_lines(got, last, width), keys, styles=styles, semantics=semantics) if detect else 0
        gone = {c for x in mine if x.fact == "hidden" for c in range(x.first_col, x.last_col + 1)} if hidden_columns == "drop" else set()
        shown = [c for c in range(width) if c not in gone] or list(range(width))
        named = {c: x.value for (r, c), x in got.items() if r == at} if at <= last else None
        tables[s.sheet], at_rows[s.sheet] = sheet_table(lines.where(F.col("sheet") == s.sheet), at, named, shown), at
    return tables, at_rows
