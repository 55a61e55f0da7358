"""Delimited text: a look at the head, one pass over the lines, then a scan by many tasks.

The passes over the lines decide what the whole file needs: its encoding, its separator
where the first row doesn't tell, whether a quoted cell holds a line break (else Spark's
own reader takes the file; see spanning.py), and the width of its widest row.
"""

from __future__ import annotations

import csv
import io
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.names import extension, sheet_name, unique_names
from ..functions.normalize import missing_words
from ..plans.headers import ROWS_NEEDED, header_row
from .spanning import SpanningText, ends_inside, parse_rows

#: Extensions by kind, and what is tried in which order.
TEXT_EXTENSIONS = ("csv", "txt", "tsv")
BOOK_EXTENSIONS = ("xlsx", "xlsm", "xls", "ods")
ENCODINGS = ("utf-8-sig", "utf-8", "latin-1", "cp1252")
SEPARATORS = {"tsv": ("\t", ",", ";", "|"), "": (",", "\t", ";", "|")}
#: What is read of a file to find its first rows; doubled until it holds them.
SAMPLE_BYTES = 1 << 20
_FIELD = 2**31 - 1
#: What Java's trim() takes off: Spark's reader passes over lines that hold nothing else.
_TRIMMED = "".join(map(chr, range(33)))
_SPARK_NAME = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "latin-1": "ISO-8859-1", "cp1252": "windows-1252"}


def is_delimited(path: str) -> bool:
    return extension(path) in TEXT_EXTENSIONS


def records(text: str, sep: str, spanning: bool) -> list[list[str]]:
    """The rows that Spark's reader delivers from a text."""
    csv.field_size_limit(_FIELD)
    if spanning:
        return [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep) if r]
    return list(csv.reader((x for x in re.split("\r\n|\n|\r", text) if x.strip(_TRIMMED)), delimiter=sep))


def encoding_of(sample: bytes, utf8: bool | None = None) -> str:
    """The first encoding that fits. ``utf8``: whether the whole file is known to be (or not to be) UTF-8; None leaves it to the sample."""
    for encoding in ENCODINGS:
        if utf8 is not None and encoding.startswith("utf-8") != utf8:
            continue
        try:
            sample.decode(encoding, "ignore" if utf8 else "strict")  # a sample may end inside a character
            return encoding
        except UnicodeDecodeError:
            continue
    raise ValueError("the sample is in none of the known encodings")


def first_separator(text: str, ext: str = "csv") -> str | None:
    """The first separator under which the first row that isn't blank has several cells; None where none splits it.

    Later rows don't count: one comma in a note or a decimal comma would make a semicolon file one of commas.
    """
    for sep in SEPARATORS.get(ext, SEPARATORS[""]):
        first = next((r for r in records(text, sep, True) if len(r) > 1 or r[0].strip()), [])
        if len(first) > 1:
            return sep
    return None


def common_separator(spark: SparkSession, path: str, ext: str = "csv", width: int | None = None) -> str:
    """The separator under which most lines of the whole file have one same width of several cells, or the width given;
    of equals the one of more cells, then the first.

    For files whose first row is a title or no header. Quoted parts of a line don't count.
    """
    tried = SEPARATORS.get(ext, SEPARATORS[""])
    bare = F.regexp_replace("value", '"[^"]*"', "")
    widths = F.array(*[F.struct(F.lit(k).alias("k"), (F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit("")))).alias("n")) for k, sep in enumerate(tried)])
    counted = spark.read.text(path).select(F.explode(widths).alias("x")).where(F.col("x.n") > 0 if width is None else F.col("x.n") == width - 1).groupBy("x.k", "x.n").agg(F.count(F.lit(1)).alias("lines"))
    best = counted.orderBy(F.desc("lines"), F.desc("n"), "k").first()
    return tried[best.k if best else 0]


def sniff(sample: bytes, ext: str = "csv", utf8: bool | None = None) -> tuple[str, str, list[list[str]]]:
    """(encoding, separator, rows) of a text that is all there is; a file goes through read_delimited."""
    encoding = encoding_of(sample, utf8)
    text = sample.decode(encoding)
    sep = first_separator(text, ext)
    if sep is None:
        width = lambda s: Counter(len(r) for r in records(text, s, True) if len(r) > 1).most_common(1)
        sep = max(SEPARATORS.get(ext, SEPARATORS[""]), key=lambda s: width(s)[0][1] if width(s) else 0)
    return encoding, sep, records(text, sep, True)


def head(spark: SparkSession, path: str, size: int = SAMPLE_BYTES) -> bytes:
    """The first bytes of a file, by Spark's own file access: any store it reads."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    stream = fs.open(where)
    try:
        size = min(size, fs.getFileStatus(where).getLen())
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size)) if size else b""
    finally:
        stream.close()


def whole_head(spark: SparkSession, path: str, rows: int = 2 * ROWS_NEEDED) -> bytes:
    """As much of the file's head as holds that many rows under any separator, or all of it; it ends with a line."""
    size = SAMPLE_BYTES
    while True:
        data = head(spark, path, size)
        if len(data) < size:
            return data
        cut = data[: data.rfind(b"\n") + 1]
        if cut and all(len(records(cut.decode("latin-1"), sep, True)) > rows for sep in SEPARATORS[""]):
            return cut
        size *= 2


def file_sizes(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Name and length of a file, or of each file in a folder, by name; hidden ones left out as Spark does."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    listed = [(f.getPath().getName(), f.getLen()) for f in fs.listStatus(where) if f.isFile()]
    return sorted((n, size) for n, size in listed if n[0] not in "._") if fs.getFileStatus(where).isDirectory() else listed


def scan_lines(spark: SparkSession, path: str) -> tuple[bool, bool]:
    """(utf8, quoted): whether all lines are UTF-8, and whether any holds a quote."""
    got = spark.read.text(path).agg(F.coalesce(F.min(F.is_valid_utf8("value")), F.lit(True)).alias("utf8"), F.coalesce(F.max(F.contains("value", F.lit('"'))), F.lit(False)).alias("quoted")).first()
    return got.utf8, got.quoted


def may_span(spark: SparkSession, path: str, sep: str, line_break: str) -> bool:
    """Whether a line can end inside a quoted cell: False only where every line's quotes are paired and open at a cell's start."""
    paired = F.regexp_replace("value", '"[^"]*"', "\x01")
    odd = F.contains(paired, F.lit('"')) | paired.rlike(f"[^\x01\r{re.escape(sep)}]\x01")
    return bool(spark.read.option("lineSep", line_break).text(path).agg(F.max(odd)).first()[0])


def widest(spark: SparkSession, path: str, width: int, options: dict, encoding: str) -> int:
    """The cells of the widest row of a file whose rows are lines, ``width`` at least.

    Lines without quotes are counted by their separators; other lines are parsed.
    """
    sep = options["sep"]

    @F.pandas_udf("int")
    def cells(rows: pd.Series) -> pd.Series:
        csv.field_size_limit(_FIELD)
        return rows.map(lambda row: 0 if row is None else max(map(len, csv.reader(io.StringIO(row, newline=""), delimiter=sep)), default=0))

    lines = spark.read.text(path)
    quoted = F.contains("value", F.lit('"'))
    plain = F.length("value") - F.length(F.replace("value", F.lit(sep), F.lit(""))) + 1
    by_count = lines.where(~quoted).agg(F.max(plain).cast("int").alias("w"))
    text = F.col("value") if encoding.startswith("utf-8") else F.decode(F.col("value").cast("binary"), _SPARK_NAME[encoding])
    by_parse = lines.where(quoted).select(cells(text).alias("w")).agg(F.max("w").alias("w"))
    most = by_count.unionAll(by_parse).agg(F.max("w").alias("w")).first().w
    return max(width, most or 0)


def read_delimited(spark: SparkSession, path: str, keys=(), header: int | None = None, semantics: str = "v2", reference=(), columns=None, sep: str | None = None) -> tuple[str, DataFrame, int]:
    """(sheet name, table of text with __rid, 0-based header row) of one file.

    Rows may be longer or shorter than the header: the schema is as wide as the widest
    row of the whole file, and short rows are padded with NULL. The encoding is that of
    the whole file: UTF-8 if all of it is, else Latin-1. The separator is that of the
    first row, or the one that most lines agree on where that row is a title. A file is
    read by many tasks whether or not its cells hold line breaks. __rid grows in file
    order. With ``columns``, names, there is no header row (-1), and the path may be a
    folder of files, which count as one after the other;
    the separator, unless given, is then the one under which most lines have a cell for each name.
    """
    files = file_sizes(spark, path)
    filled = next((name for name, size in files if size), None)
    first = path if filled is None or path.rstrip("/").endswith(f"/{filled}") else f"{path.rstrip('/')}/{filled}"
    utf8, quoted = scan_lines(spark, path)
    sample = whole_head(spark, first, max(2 * ROWS_NEEDED, (header or 0) + 1))
    encoding = encoding_of(sample, utf8)
    start = sample.decode(encoding, "ignore")
    if sep is not None:
        pass
    elif columns is not None:
        sep = common_separator(spark, path, extension(path), len(columns))
    else:
        sep = first_separator(start, extension(path)) or common_separator(spark, path, extension(path))
    line_break = "\r" if b"\n" not in sample and b"\r" in sample else "\n"
    spanning = SpanningText(spark, path, sep, encoding, files, line_break) if quoted and may_span(spark, path, sep, line_break) else None
    spans = spanning is not None and spanning.spans
    if spans:
        placed = head_rows(sample, line_break.encode(), encoding, sep)
    else:
        placed = list(enumerate(records(start, sep, False)))
    grid = [[c if c.strip() else None for c in r] for _, r in placed[:ROWS_NEEDED]]
    least = max((len(r) for r in grid), default=1)
    if spans:
        rows, width = spanning.rows()
        width = max(width, least)
        cells = [F.get("cells", F.lit(k)) for k in range(width)]
        raw = rows.select(*[F.when(c != "", c).alias(f"c{k}") for k, c in enumerate(cells)], F.col("rid").alias("__rid"))
    else:
        options = {"sep": sep, "encoding": _SPARK_NAME[encoding], "header": False, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        width = widest(spark, path, least, options, encoding)
        schema = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(width)])
        raw = spark.read.csv(path, schema=schema, maxColumns=max(width, 512), maxCharsPerColumn=-1, **options).withColumn("__rid", F.monotonically_increasing_id())
    if columns is not None:
        at, named, after = -1, list(columns), -1
    else:
        at = header if header is not None else header_row([r + [None] * (width - len(r)) for r in grid], keys, reference, semantics=semantics)
        named = [c if c.strip() else None for c in placed[at][1]] if at < len(placed) else []
        after = placed[at][0] if at < len(placed) else _FIELD << 31  # no row is that far down
    names = unique_names(list(named) + [None] * (width - len(named)))
    full = F.coalesce(*[F.col(f"c{k}") for k in range(width)]).isNotNull()
    bom = F.regexp_replace("c0", "^\ufeff", "") if encoding == "utf-8-sig" else F.col("c0")
    body = raw.withColumn("c0", bom).where(full).where(F.col("__rid") > after)
    return sheet_name(path), body.select(*[missing_words(F.col(f"c{k}")).alias(n) for k, n in enumerate(names)], "__rid"), at


def head_rows(sample: bytes, line_break: bytes, encoding: str, sep: str) -> list[tuple[int, list[str]]]:
    """(rid, cells) of the rows at the head of a file whose rows span lines, numbered as SpanningText does."""
    out, held, at, place, inside = [], [], 0, 0, False
    sample = sample.removesuffix(line_break)
    for k, line in enumerate(sample.split(line_break)):
        bare = line.removeprefix(b"\xef\xbb\xbf") if k == 0 else line
        at = at if held else place
        held.append(bare)
        place += len(line) + 1
        inside = ends_inside(bare, inside, ord(sep))
        if not inside:
            out += [(at + i, cells) for i, cells in parse_rows(line_break.join(held), "utf-8" if encoding == "utf-8-sig" else encoding, sep)]
            held = []
    if held:
        out += [(at + i, cells) for i, cells in parse_rows(line_break.join(held), "utf-8" if encoding == "utf-8-sig" else encoding, sep)]
    return out
