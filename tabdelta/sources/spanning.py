"""Delimited text whose quoted cells hold line breaks, read by many tasks.

Where a row begins depends on whether all text before it leaves a quote open, so such a
file seems to need one reader. It is a prefix scan instead: each split tells, for either
state it might start in (outside or inside a quoted cell), in which state it ends; the
driver composes these small functions, a row per split, in file order; then every split
knows its state and parses its own rows. A row that crosses splits is put together from
its fragments, at most one per split.

The states are those of Python's csv reader: a quote opens a cell only at its start, a
doubled quote stays inside, text after a closing quote belongs to the cell, and quotes
in an unquoted cell are text; the last line break of a file is no part of a cell left open. Lines without a quote don't change the state and are left
out of the first pass before it reaches Python.

Rows are numbered by where they start: the split's offset plus the bytes before the row
in its split, which grows in file order and never repeats. Several files count as one
after the other, each starting outside quotes.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.staging import staged

_QUOTE, _BOM = 0x22, b"\xef\xbb\xbf"
_ROWS = pa.schema([("rid", pa.int64()), ("cells", pa.list_(pa.string()))])
_FACTS = pa.schema([("file", pa.string()), ("block", pa.int64()), ("from_out", pa.bool_()), ("opens", pa.bool_()), ("from_in", pa.bool_()), ("closes", pa.bool_())])
_PIECES = pa.schema([("origin", pa.string()), ("seq", pa.int64()), ("rid", pa.int64()), ("text", pa.binary()), ("width", pa.int32())])
BATCH = 2000


def ends_inside(line: bytes, inside: bool, sep: int) -> bool:
    """Whether a line ends inside a quoted cell, from the state it starts in."""
    breaks = (sep, 10, 13)
    at, n = 0, len(line)
    while True:
        if inside:
            at = line.find(b'"', at)
            while at >= 0 and at + 1 < n and line[at + 1] == _QUOTE:
                at = line.find(b'"', at + 2)
        else:
            at = line.find(b'"', at)
            while at > 0 and line[at - 1] not in breaks:
                at = line.find(b'"', at + 1)
        if at < 0:
            return inside
        inside, at = not inside, at + 1


def parse_rows(text: bytes, encoding: str, sep: str) -> list[tuple[int, list[str]]]:
    """(place, cells) of the rows in the text of one or more whole lines; empty lines give none."""
    csv.field_size_limit(2**31 - 1)
    found = csv.reader(io.StringIO(text.decode(encoding), newline=""), delimiter=sep)
    return [(k, row) for k, row in enumerate(found) if row]  # a row takes a byte at least, so places never run into the next line


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes, int]]:
    """(file, split, line, place of the line in its split) of the rows that Spark's text scan delivers."""
    now, place = None, 0
    for batch in batches:
        for file, block, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if (file, block) != now:
                now, place = (file, block), 0
            if block == 0 and place == 0 and line.startswith(_BOM):
                yield file, block, line[3:], place
            else:
                yield file, block, line, place
            place += len(line) + 1


@dataclass(frozen=True)
class Layout:
    """How files are written, and where each begins when they count as one after the other."""

    sep: str
    encoding: str
    line_break: str
    base: dict[str, int]


def transitions(batches: Iterator[pa.RecordBatch], sep: int) -> Iterator[pa.RecordBatch]:
    """Per split, for either state it may start in: the state it ends in, and whether a line ended inside or outside a cell."""
    facts = {}
    for file, block, line, _ in _lines(batches):
        from_out, opens, from_in, closes = facts.get((file, block), (False, False, True, False))
        from_out, from_in = ends_inside(line, from_out, sep), ends_inside(line, from_in, sep)
        facts[file, block] = (from_out, opens or from_out, from_in, closes or not from_in)
    yield pa.RecordBatch.from_pylist([{"file": f, "block": b, "from_out": x[0], "opens": x[1], "from_in": x[2], "closes": x[3]} for (f, b), x in facts.items()], schema=_FACTS)


def walk(batches: Iterator[pa.RecordBatch], layout: Layout, start: dict[tuple[str, int], tuple[str, int]], want_rows: bool) -> Iterator[tuple]:
    """Rows that begin and end in one split, as (rid, cells); else the fragments of all others as (origin, seq, rid, text, None)
    and last the width of the widest whole row as (None, None, None, None, width)."""
    sep, glue = ord(layout.sep), layout.line_break.encode()
    now = origin = held_at = None
    held, inside, widest = [], False, 0

    def fragment() -> tuple:
        file, block = now
        return "{1} {0}".format(*(origin or now)), layout.base[file] + block, None if origin else held_at, glue.join(held), None

    for file, block, line, place in _lines(batches):
        if (file, block) != now:
            if held and not want_rows:
                yield fragment()
            now, held, origin = (file, block), [], start.get((file, block))
            inside = origin is not None
        if not held:
            held_at = layout.base[file] + block + place
        held.append(line)
        if b'"' in line:
            inside = ends_inside(line, inside, sep)
        if inside:
            continue
        if origin is None:
            for k, cells in parse_rows(glue.join(held), layout.encoding, layout.sep):
                if want_rows:
                    yield held_at + k, cells
                widest = max(widest, len(cells))
        elif not want_rows:
            yield fragment()
        held, origin = [], None
    if not want_rows:
        if held:
            yield fragment()
        yield None, None, None, None, widest


class SpanningText:
    """Delimited files as rows of cells. ``sizes``: name and length of each, in order; ``line_break``: what ends lines, CR only where no LF does."""

    def __init__(self, spark: SparkSession, path: str, sep: str, encoding: str, sizes: list[tuple[str, int]], line_break: str = "\n"):
        offsets = [0, *accumulate(size for _, size in sizes)]
        self.layout = Layout(sep, "utf-8" if encoding == "utf-8-sig" else encoding, line_break, {name: at for (name, _), at in zip(sizes, offsets)})
        text = spark.read.option("lineSep", line_break).text(path)
        self.lines = text.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))
        self.start, self.spans = self._compose()

    def _compose(self) -> tuple[dict[tuple[str, int], tuple[str, int]], bool]:
        """Per split that starts inside a cell the split in which its row begins; and whether any row spans lines."""
        sep = ord(self.layout.sep)
        quoted = self.lines.where(F.contains("line", F.lit(b'"')) | (F.col("block") == 0))
        facts = quoted.mapInArrow(lambda batches: transitions(batches, sep), "file string, block long, from_out boolean, opens boolean, from_in boolean, closes boolean")
        found = self.lines.select("file", "block").distinct().join(facts, ["file", "block"], "left").collect()  # a row per split
        start, spans, inside, origin, last = {}, False, False, None, None
        for r in sorted(found, key=lambda r: (self.layout.base[r.file], r.block)):
            if r.file != last:
                inside, last = False, r.file
            if inside:
                start[r.file, r.block] = origin
            if r.from_out is None:
                continue  # without quotes the state stays
            spans = spans or inside or r.opens
            if not inside or r.closes:
                origin = (r.file, r.block)
            inside = r.from_in if inside else r.from_out
        return start, spans

    def rows(self) -> tuple[DataFrame, int]:
        """(rid, cells) of all rows, and the number of cells of the widest."""
        layout, start = self.layout, self.start

        def pieces(batches):
            rows = [dict(zip(_PIECES.names, x)) for x in walk(batches, layout, start, False)]
            yield pa.RecordBatch.from_pylist(rows, schema=_PIECES)

        def crossing(batches):
            for batch in batches:
                for rid, texts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    found = parse_rows(layout.line_break.encode().join(texts), layout.encoding, layout.sep)
                    yield pa.RecordBatch.from_pylist([{"rid": rid + k, "cells": cells} for k, cells in found], schema=_ROWS)

        def whole(batches):
            out = []
            for rid, cells in walk(batches, layout, start, True):
                out.append({"rid": rid, "cells": cells})
                if len(out) == BATCH:
                    yield pa.RecordBatch.from_pylist(out, schema=_ROWS)
                    out = []
            yield pa.RecordBatch.from_pylist(out, schema=_ROWS)

        found = staged(self.lines.mapInArrow(pieces, "origin string, seq long, rid long, text binary, width int"))
        texts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"])  # of one row
        joined = found.where("origin IS NOT NULL").groupBy("origin").agg(F.max("rid").alias("rid"), texts.alias("texts")).select("rid", "texts")
        joined = staged(joined.mapInArrow(crossing, "rid long, cells array<string>"))
        width = max(found.agg(F.max("width")).first()[0] or 0, joined.agg(F.max(F.size("cells"))).first()[0] or 0)
        return self.lines.mapInArrow(whole, "rid long, cells array<string>").unionByName(joined), width
