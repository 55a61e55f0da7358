"""Highlighted workbooks of any number of differences, written by tasks.

1. Rows are ranged by (status, order number), so every range is a stretch of the result in
   source order, and then rendered as XML by native expressions.
2. Tasks deflate stretches of rows into fragments of a worksheet. A fragment ends on a
   byte with nothing referring back, so fragments laid one after the other are a valid
   stream; its checksum follows from theirs. Fragments go to the shared folder.
3. Fragments are dealt to books by running totals, so that no worksheet passes the
   format's row limit and no book about a gigabyte; a task assembles whole books by
   copying fragments, which costs no compression.
4. The driver, which sees a row per book, moves the finished books to their place. Until
   then they are in a folder of this run, and what a lost task or a failed run left there
   goes with it.

Sheets are those of ``sinks.xlsx``: old values, new values (differing cells filled),
added, removed. A result without rows gives one book of empty sheets; a null cell is an
empty cell; rows without an order number come first; characters that XML can't hold are
left out. The target folder must be one that all tasks can write to.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.staging import discard, scratch
from .xlsx import _ADDED, _BAD, _NEW, _OLD, _REMOVED, MAX_ROWS, TITLES, package_parts

FRAGMENT_ROWS = 10_000
FRAGMENT_BYTES = 16 << 20
BOOK_BYTES = 1 << 28  # of XML for each status
_FRAGMENT = "sheet int, part int, seq long, n_rows long, raw long, crc long, data binary"
_BOOK = "book long, path string, n_old long, n_new long, n_added long, n_removed long"
_STATUSES = ("changed", "added", "removed")
_POLYNOMIAL = 0xEDB88320  # fixed value: the checksum of zip files


def _times(a: int, b: int) -> int:
    """The product of two polynomials modulo the checksum's, lowest power in the highest bit."""
    out, bit = 0, 1 << 31
    while bit:
        if a & bit:
            out ^= b
        b = (b >> 1) ^ (_POLYNOMIAL if b & 1 else 0)
        bit >>= 1
    return out


def joined_crc(first: int, second: int, length: int) -> int:
    """The checksum of two texts one after the other, of theirs and the length of the second."""
    power, shift = 1 << 23, 1 << 31  # x to the 8, and 1
    while length:
        if length & 1:
            shift = _times(shift, power)
        power, length = _times(power, power), length >> 1
    return _times(first, shift) ^ second


def fragment(xml: bytes, level: int = 6) -> tuple[int, int, bytes]:
    """(length, checksum, bytes) of a stretch that can stand anywhere in a deflated stream but at its end."""
    pack = zlib.compressobj(level, zlib.DEFLATED, -15)
    return len(xml), zlib.crc32(xml), pack.compress(xml) + pack.flush(zlib.Z_FULL_FLUSH)


class Package:
    """A zip file written front to back from deflated fragments."""

    _END = b"\x03\x00"  # an empty last block

    def __init__(self, out):
        self.out, self.at, self.listed = out, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, fragments: Iterable[tuple[int, int, bytes]]) -> None:
        start, crc, raw, size = self.at, 0, 0, len(self._END)
        label = name.encode()
        self._put(struct.pack("<IHHHHHIIIHH", 0x04034B50, 20, 8, 8, 0, 33, 0, 0, 0, len(label), 0) + label)  # sizes follow the data
        for length, own, data in fragments:
            crc, raw, size = joined_crc(crc, own, length), raw + length, size + len(data)
            self._put(data)
        if raw >= 1 << 32 or size >= 1 << 32:
            raise ValueError(f"{name} is larger than a plain zip file can hold")
        self._put(self._END + struct.pack("<IIII", 0x08074B50, crc, size, raw))
        self.listed.append((label, start, crc, size, raw))

    def close(self) -> None:
        start = self.at
        if start >= 1 << 32:
            raise ValueError("the book is larger than a plain zip file can be")
        for label, at, crc, size, raw in self.listed:
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 20, 20, 8, 8, 0, 33, crc, size, raw, len(label), 0, 0, 0, 0, 0, at) + label)
        self._put(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, len(self.listed), len(self.listed), self.at - start, start, 0))


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path):
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), path


def _row_xml(side: str, columns: list[str], style) -> Column:
    """A row of cells without places, which count on by themselves. ``style``: of a column's name, its format as a Column."""
    bad = _BAD.pattern

    def cell(c: str) -> Column:
        text = F.regexp_replace(F.col(f"{side}.`{c}`").cast("string"), bad, "")
        for ch, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")):
            text = F.replace(text, F.lit(ch), F.lit(name))
        full = F.concat(F.lit('<c t="inlineStr" s="'), style(c), F.lit('"><is><t xml:space="preserve">'), text, F.lit("</t></is></c>"))
        return F.coalesce(full, F.lit("<c/>"))

    return F.concat(F.lit("<row>"), *map(cell, columns), F.lit("</row>"))


def _rendered(ranged: DataFrame, columns: list[str]) -> DataFrame:
    """(rank, one, two): the row's XML on its first sheet and, of changed rows, on the second."""
    always = lambda k: lambda c: F.lit(str(k))
    differing = lambda k: lambda c: F.when(F.array_contains("changed_cols", c), F.lit(str(k))).otherwise(F.lit("0"))
    is_ = lambda k: F.col("rank") == k
    one = F.when(is_(0), _row_xml("old", columns, differing(_OLD))).when(is_(1), _row_xml("new", columns, always(_ADDED))).otherwise(_row_xml("old", columns, always(_REMOVED)))
    return ranged.select("rank", one.alias("one"), F.when(is_(0), _row_xml("new", columns, differing(_NEW))).alias("two"))


def fragments(diff: DataFrame, columns: list[str], order: str | None = "rid", rows: int = FRAGMENT_ROWS) -> DataFrame:
    """Deflated stretches of the four worksheets; (part, seq) is their order within a sheet."""
    spark = diff.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rank = F.when(F.col("status") == _STATUSES[0], 0).when(F.col("status") == _STATUSES[1], 1).otherwise(2)
    place = (F.col(order) if order else F.lit(None)).cast("long")
    plain = diff.select(rank.alias("rank"), place.alias("place"), "old", "new", "changed_cols").withColumn("own", F.xxhash64("old", "new"))  # the hash splits rows without a place
    ranged = plain.repartitionByRange(tasks, "rank", "place", "own").sortWithinPartitions("rank", "place", "own")

    def run(batches) -> Iterator[pa.RecordBatch]:
        part, seq, rank, held, size = TaskContext.get().partitionId(), 0, None, ([], []), 0

        def done():
            for k, texts in enumerate(held):
                if texts:
                    raw, crc, data = fragment("".join(texts).encode("utf-8", "replace"))
                    sheet = k if rank == 0 else rank + 1
                    yield pa.RecordBatch.from_pydict({"sheet": pa.array([sheet], pa.int32()), "part": pa.array([part], pa.int32()), "seq": [seq], "n_rows": [len(texts)], "raw": [raw], "crc": [crc], "data": [data]})

        for b in batches:
            for r, one, two in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if r != rank or len(held[0]) == rows or size > FRAGMENT_BYTES:
                    yield from done()
                    rank, held, size, seq = r, ([], []), 0, seq + 1
                held[0].append(one)
                size += len(one)
                if two is not None:
                    held[1].append(two)
                    size += len(two)
        yield from done()

    return _rendered(ranged, columns).mapInArrow(run, _FRAGMENT)


def write_books(diff: DataFrame, columns: list[str], folder: str, name: str = "changes", order: str | None = "rid", titles: tuple[str, ...] = TITLES, rows_per_sheet: int = MAX_ROWS - 1) -> list[dict]:
    """Write all differences (status, old, new, changed_cols and ``order``) as workbooks in ``folder``: name.xlsx, or name_1.xlsx and so on.

    Returns a row per book: its path and the rows of each sheet.
    """
    if not 2 <= rows_per_sheet < MAX_ROWS:
        raise ValueError(f"rows_per_sheet is outside 2..{MAX_ROWS - 1}")
    spark = diff.sparkSession
    step = max(1, min(FRAGMENT_ROWS, rows_per_sheet // 2))
    where = scratch(spark, "fragments")
    fragments(diff, columns, order, step).write.parquet(where, compression="none")  # they are deflated
    found = spark.read.schema(_FRAGMENT).parquet(where)
    # Old and new values of changed rows lie in fragments of one number, so they go to one book: totals are taken over both.
    rank = F.greatest(F.col("sheet") - 1, F.lit(0))
    numbers = found.groupBy(rank.alias("rank"), "part", "seq").agg(F.max("n_rows").alias("n"), F.sum("raw").alias("raw"))
    before = Window.partitionBy("rank").orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row per fragment, without its bytes
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    dealt = numbers.withColumn("book", F.floor(total("n") / (rows_per_sheet - step + 1)) + F.floor(total("raw") / BOOK_BYTES)).select("rank", "part", "seq", "book")
    placed = found.withColumn("rank", rank).join(dealt, ["rank", "part", "seq"]).select("book", "sheet", "part", "seq", "n_rows", "raw", "crc", "data")
    none = spark.range(1).select(F.lit(0).cast("long").alias("book"), F.lit(0).alias("sheet"), F.lit(-1).alias("part"), *[F.lit(0).cast("long").alias(c) for c in ("seq", "n_rows", "raw", "crc")], F.lit(b"").alias("data"))
    n_books = (dealt.agg(F.count_distinct("book")).first()[0] or 1)
    tasks = min(n_books, max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    aside = f"{folder.rstrip('/')}/_unfinished-{uuid.uuid4().hex}"
    store, inner = _store(aside)
    store.create_dir(inner, recursive=True)
    try:
        books = placed.unionByName(none).repartition(tasks, "book").sortWithinPartitions("book", "sheet", "part", "seq").mapInArrow(_assembler(aside, columns, titles), _BOOK)
        out = []
        for k, b in enumerate(sorted(books.collect(), key=lambda b: b.book)):  # a row per book
            target = f"{folder.rstrip('/')}/{name}{'' if n_books == 1 else f'_{k + 1}'}.xlsx"
            store.move(_store(b.path)[1], _store(target)[1])
            out.append({"path": target, **{c: b[c] for c in ("n_old", "n_new", "n_added", "n_removed")}})
        return out
    finally:
        store.delete_dir(inner)
        discard(spark, where)


def _assembler(folder: str, columns: list[str], titles: tuple[str, ...]):
    """Of fragments in order of book and sheet, the books; a book is written under a name of its own attempt."""
    before, after, others = package_parts([(t, columns) for t in titles])

    def run(batches) -> Iterator[pa.RecordBatch]:
        stream = (x for b in batches for x in zip(*(b.column(c).to_pylist() for c in ("book", "sheet", "n_rows", "raw", "crc", "data"))))
        held = next(stream, None)
        while held is not None:
            book, counts = held[0], [0] * len(titles)
            path = f"{folder}/{book}-{uuid.uuid4().hex}.xlsx"
            store, inner = _store(path)
            with store.open_output_stream(inner) as out:
                package = Package(out)
                for member, text in others:
                    package.add(member, [fragment(text.encode())])

                def sheet(k: int):
                    nonlocal held
                    yield fragment(before[k].encode())
                    while held is not None and held[:2] == (book, k):
                        counts[k] += held[2]
                        if held[2]:
                            yield held[3:]
                        held = next(stream, None)
                    yield fragment(after.encode())

                for k in range(len(titles)):
                    package.add(f"xl/worksheets/sheet{k + 1}.xml", sheet(k))
                package.close()
            yield pa.RecordBatch.from_pydict({"book": [book], "path": [path], "n_old": [counts[0]], "n_new": [counts[1]], "n_added": [counts[2]], "n_removed": [counts[3]]})

    return run
