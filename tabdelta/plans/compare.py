"""From paired tables or workbooks to one result.

Strategies are chosen before any plan is built, so an error in a plan is an error
and not a silent change of strategy. The choice needs one aggregate per side (the
key's uniqueness); everything else is lazy.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..functions.names import parse_keys
from ..operators import report
from ..operators.keyed import ORDER, KeyedDiff, common_columns, with_changed, with_order
from ..operators.keyless import KeylessDiff
from ..operators.keys import choose_key
from ..operators.blocks import Reconciled
from ..operators.staging import staged
from .align import align


@dataclass
class SheetResult:
    """A sheet's differences in the contract of all comparisons: status, key, rid, old, new, changed_cols."""

    sheet: str
    key_description: str
    diff: DataFrame
    columns: list[str]
    truncation: DataFrame
    strategy: str

    def changed(self) -> DataFrame:
        return self.diff.where("status = 'changed'")

    def summary(self) -> DataFrame:
        return report.summary(self.diff)

    def cells(self) -> DataFrame:
        return report.cell_diff(self.changed(), self.columns)

    def side_by_side(self) -> DataFrame:
        return report.side_by_side(self.changed(), self.columns)


@dataclass
class WorkbookResult:
    sheets: list[SheetResult]
    only_old: list[str] = field(default_factory=list)
    only_new: list[str] = field(default_factory=list)


def compare_tables(old: DataFrame, new: DataFrame, keys: str | list[str] = (), sheet: str = "", semantics: str = "v2", composite: bool = False, reconcile: bool = True, multiset: str | None = None, aligned: bool = False) -> SheetResult:
    """Compare two tables, by key where one is valid, else by rows with fuzzy reconciliation."""
    wanted = parse_keys(keys) if isinstance(keys, str) else list(keys)
    if not aligned:
        new = align(new, old, semantics)
    columns = common_columns(old, new)
    shown = lambda df: df.select([F.col(f"`{c}`") for c in df.columns if c != ORDER])
    chosen, description = choose_key(shown(old), shown(new), wanted, semantics, composite)
    cut = report.truncation(shown(old), shown(new))
    if chosen:
        return SheetResult(sheet, description, KeyedDiff(old, new, chosen, semantics=semantics).result(), columns, cut, "keyed")
    mode = multiset or ("set" if semantics == "v1" else "count")
    diff = KeylessDiff(with_order(old, None), with_order(new, None), mode)
    if mode == "exact":
        plain = lambda df, side: df.select(F.lit(side).alias("status"), F.lit("").alias("key"), F.lit(None).cast("long").alias("rid"), *_sides(df, side, columns))
        return SheetResult(sheet, description, plain(diff.added(), "added").unionByName(plain(diff.removed(), "removed")), columns, cut, "keyless")
    found = diff.both()
    if reconcile and semantics != "v1" and columns:
        found = staged(found)  # rows are numbered here for the last time, whatever their source does when it is read again
    pick = lambda side, rid: found.where(F.col("status") == side).select(F.col(ORDER).alias(rid), "row")
    removed, added = pick("removed", "ri"), pick("added", "ai")
    none = F.array().cast("array<string>")
    pieces = []
    if reconcile and semantics != "v1" and columns:
        matched = Reconciled(removed, added, columns, semantics=semantics)
        pairs = with_changed(matched.changed(), columns, [], semantics=semantics)
        pieces.append(pairs.select(F.lit("changed").alias("status"), F.lit("").alias("key"), F.col("ri").alias("rid"), "old", "new", "changed_cols"))
        removed, added = matched.still_removed(), matched.still_added()
    row, whole = removed.schema["row"].dataType, F.col("row")
    pieces.append(added.select(F.lit("added").alias("status"), F.lit("").alias("key"), F.col("ai").alias("rid"), F.lit(None).cast(row).alias("old"), whole.alias("new"), none.alias("changed_cols")))
    pieces.append(removed.select(F.lit("removed").alias("status"), F.lit("").alias("key"), F.col("ri").alias("rid"), whole.alias("old"), F.lit(None).cast(row).alias("new"), none.alias("changed_cols")))
    out = pieces[0]
    for p in pieces[1:]:
        out = out.unionByName(p)
    return SheetResult(sheet, description, out, columns, cut, "keyless")


def _sides(df: DataFrame, side: str, columns: list[str]):
    row = F.struct(*[F.col(f"row.`{c}`").alias(c) for c in columns])
    empty = F.lit(None).cast(df.select(row.alias("r")).schema["r"].dataType)
    return (row if side == "removed" else empty).alias("old"), (row if side == "added" else empty).alias("new"), F.array().cast("array<string>").alias("changed_cols")


def compare_workbooks(old: dict[str, DataFrame], new: dict[str, DataFrame], keys: str | list[str] = (), **options) -> WorkbookResult:
    """Compare sheets of equal names, sorted. Two single-table files are compared whatever their names."""
    if len(old) == len(new) == 1 and set(old) != set(new):
        (name, table), (_, other) = next(iter(old.items())), next(iter(new.items()))
        return WorkbookResult([compare_tables(table, other, keys, sheet=name, **options)])
    both = sorted(set(old) & set(new))
    return WorkbookResult([compare_tables(old[s], new[s], keys, sheet=s, **options) for s in both], sorted(set(old) - set(new)), sorted(set(new) - set(old)))


def combined(results: dict[str, WorkbookResult]) -> DataFrame:
    """All differences of many pairs in one flat table: pair_id, sheet, status, key, rid, changed_cols, old and new as JSON."""
    out = None
    for pair, book in results.items():
        for s in book.sheets:
            one = s.diff.select(F.lit(pair).alias("pair_id"), F.lit(s.sheet).alias("sheet"), "status", "key", "rid", "changed_cols", F.to_json("old").alias("old"), F.to_json("new").alias("new"))
            out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("nothing was compared")
    return out
