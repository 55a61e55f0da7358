"""From two collections of files to results: pair, read, align, compare.

A pair that can't be read is reported with its error; the others go on. Reading
is memoised by content, so comparing the same files again costs no parsing.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.names import extension_column, header_index, parse_keys, sheet_name_column
from ..operators import report
from ..sources.delimited import is_delimited, read_delimited
from ..sources.workbook import catalog, read_workbook
from .compare import WorkbookResult, combined, compare_workbooks
from .headers import effective_rows, merge_detected
from .pairing import THRESHOLD, Pair, pair_files, unmatched, with_manual

log = logging.getLogger(__name__)


def describe_files(spark: SparkSession, glob: str, side: str) -> DataFrame:
    """(side, path, name, ext, sheet, length, digest) of files, contents never leaving the executors."""
    files = spark.read.format("binaryFile").load(glob)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select(F.lit(side).alias("side"), "path", name.alias("name"), extension_column(name).alias("ext"), sheet_name_column(name).alias("sheet"), "length", F.sha2("content", 256).alias("digest"))


#: Options that say how a workbook is read; all others of compare_files say how tables are compared.
READING = ("sheets", "hidden_columns", "password", "on_error")


@dataclass
class TableCache:
    """Tables of files already read, by content and reading options; clear() forgets and unpersists them."""

    known: dict = field(default_factory=dict)

    def get(self, path: str, version: tuple, options: tuple, read: Callable) -> tuple:
        """What was read of this version of the file with these options; other versions are forgotten."""
        for key in [k for k in self.known if k[0] == path and k[1] != version]:
            self._forget(key)
        key = (path, version, options)
        if key not in self.known:
            tables, rows = read()
            self.known[key] = {s: t.persist() for s, t in tables.items()}, rows
        return self.known[key]

    def _forget(self, key: tuple) -> None:
        for t in self.known.pop(key)[0].values():
            t.unpersist(blocking=True)

    def clear(self) -> None:
        for key in list(self.known):
            self._forget(key)


def file_version(spark: SparkSession, path: str) -> tuple:
    """What changes when a file does: length, time, and a digest of the content (by lines, in parallel, for text)."""
    spark.catalog.refreshByPath(path)
    files = spark.read.format("binaryFile").load(path)
    if not is_delimited(path):
        return tuple(files.select(F.sha2("content", 256), F.unix_micros("modificationTime")).first())
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    text = lines.select(F.xxhash64("value", "at").alias("h")).agg(F.count(F.lit(1)), F.coalesce(F.bit_xor("h"), F.lit(0))).first()
    return (*files.select("length", F.unix_micros("modificationTime")).first(), *text)


def read_file(spark: SparkSession, path: str, keys=(), header_overrides: dict[str, int] | None = None, cache: TableCache | None = None, semantics: str = "v2", **reading) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """Tables and 0-based header rows of one file of any supported kind; ``reading``: options of read_workbook."""

    def read():
        if is_delimited(path):
            row = next(iter(effective_rows({}, header_overrides).values()), None)
            name, df, at = read_delimited(spark, path, keys, None if row is None else header_index(row), semantics)
            return {name: df}, {name: at}
        return read_workbook(spark, path, keys, header_overrides=header_overrides, semantics=semantics, **reading)

    if cache is None:
        return read()
    options = (tuple(keys), tuple(sorted((header_overrides or {}).items())), semantics, tuple(sorted(reading.items())))
    return cache.get(path, file_version(spark, path), options, read)


def propose_headers(spark: SparkSession, paths: Sequence[str], keys=()) -> dict[str, int]:
    """1-based header rows per sheet over all files, to be shown before a run."""
    found = []
    for path in paths:
        if is_delimited(path):
            name, _, at = read_delimited(spark, path, keys)
            found.append({name: at + 1})
        else:
            found.append(catalog(spark, path, keys))
    return merge_detected(found)


@dataclass
class BatchResult:
    pairs: list[Pair]
    results: dict[str, WorkbookResult]
    errors: dict[str, str]
    unmatched_old: list[str]
    unmatched_new: list[str]

    def differences(self) -> DataFrame:
        return combined(self.results)

    def summary(self, spark: SparkSession) -> DataFrame:
        """Pairs compared, pairs that differ, and whether all agree; pairs that failed aren't counted."""
        rows = None
        for name, book in self.results.items():
            for s in book.sheets:
                one = s.summary().withColumn("pair_id", F.lit(name))
                rows = one if rows is None else rows.unionByName(one)
        if rows is None:
            rows = spark.createDataFrame([], "n_changed long, n_added long, n_removed long, pair_id string")
        return report.run_summary(rows)


def compare_files(spark: SparkSession, old: Sequence[str], new: Sequence[str], keys: str | list[str] = (), threshold: float = THRESHOLD, ignore_suffix: bool = False, manual: Sequence[tuple[str, str]] = (), header_overrides: dict[str, dict[str, int]] | None = None, new_header: str = "detect", cache: TableCache | None = None, semantics: str = "v2", progress: Callable[[int, int], None] | None = None, **options) -> BatchResult:
    """Compare files paired by name.

    header_overrides: per side ("old", "new"), 1-based rows by sheet. new_header
    ``inherit`` reads NEW sheets at the header rows found in OLD. Options named in
    READING go to the workbook reader, all others to the comparison.
    """
    reading = {k: options.pop(k) for k in READING if k in options}
    if new_header not in ("detect", "inherit"):
        raise ValueError("new_header is detect or inherit")
    base = lambda p: p.rsplit("/", 1)[-1]
    left, right = {base(p): p for p in old}, {base(p): p for p in new}
    pairs = with_manual(pair_files(list(left), list(right), threshold, ignore_suffix), list(manual))
    wanted = parse_keys(keys) if isinstance(keys, str) else list(keys)
    results, errors = {}, {}
    for done, pair in enumerate(pairs):
        name = f"{pair.old} / {pair.new}"
        try:
            own = header_overrides or {}
            a, rows = read_file(spark, left[pair.old], wanted, own.get("old"), cache, semantics, **reading)
            there = {s: r + 1 for s, r in rows.items()} if new_header == "inherit" else own.get("new")
            b, _ = read_file(spark, right[pair.new], wanted, there, cache, semantics, **reading)
            results[name] = compare_workbooks(a, b, wanted, semantics=semantics, **options)
        except Exception as e:  # noqa: BLE001  one unreadable pair is reported and doesn't stop the rest
            errors[name] = f"{type(e).__name__}: {e}"
            log.warning("pair %s: %s", name, errors[name])
        if progress:
            progress(done + 1, len(pairs))
    return BatchResult(pairs, results, errors, *unmatched(list(left), list(right), pairs))
