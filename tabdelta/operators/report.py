"""Views of a comparison: counts, cells, side by side, truncation, missing sheets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.normalize import strip_blanks


def summary(diff: DataFrame) -> DataFrame:
    """Rows per status; statuses without rows count 0."""
    return diff.agg(*[F.count(F.when(F.col("status") == s, 1)).alias(f"n_{s}") for s in ("changed", "added", "removed")])


def run_summary(results: DataFrame) -> DataFrame:
    """From rows (pair_id, n_changed, n_added, n_removed): pairs compared, pairs that differ, whether all agree."""
    differs = (F.col("n_changed") + F.col("n_added") + F.col("n_removed")) > 0
    per_pair = results.groupBy("pair_id").agg(F.max(differs.cast("int")).alias("d"))
    return per_pair.agg(F.count(F.lit(1)).alias("n_pairs"), F.coalesce(F.sum("d"), F.lit(0)).alias("n_pairs_differ"), F.coalesce(F.sum("d") == 0, F.lit(True)).alias("identical"))


def cell_diff(changed: DataFrame, columns: list[str]) -> DataFrame:
    """One row per changed cell: key, column, old and new raw values."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"old.`{c}`").alias("old_value"), F.col(f"new.`{c}`").alias("new_value")) for c in columns])
    long = changed.select("key", "changed_cols", F.explode(cells).alias("cell"))
    return long.where(F.array_contains("changed_cols", F.col("cell.column"))).select("key", "cell.column", "cell.old_value", "cell.new_value")


def changed_by_column(changed: DataFrame) -> DataFrame:
    return changed.select(F.explode("changed_cols").alias("column")).groupBy("column").agg(F.count(F.lit(1)).alias("n_changed"))


def side_by_side(changed: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of both sides interleaved, with the names of those that differ."""
    pairs = [x for c in columns for x in (F.col(f"old.`{c}`").alias(f"{c} (Old)"), F.col(f"new.`{c}`").alias(f"{c} (New)"))]
    return changed.select("key", *pairs, "changed_cols")


def paired_by_position(changed: DataFrame) -> DataFrame:
    """Old and new rows under one number; a changed row carries both, so there is nothing to align."""
    return changed.select(F.col("rid"), "old", "new")


def nonempty(columns: list[str], blanks: bool = True) -> Column:
    """Whether a row has a cell. By default a blank text counts as a cell, as in the compared tables."""
    cells = [F.col(f"`{c}`").isNotNull() if blanks else F.coalesce(~strip_blanks(F.col(f"`{c}`")).isin("", "nan"), F.lit(False)) for c in columns]
    return reduce(lambda a, b: a | b, cells, F.lit(False))


def truncation(old: DataFrame, new: DataFrame, blanks: bool = True) -> DataFrame:
    """One row: whether NEW lost at least max(5, a tenth) of OLD's rows, and both counts."""
    a = old.agg(F.count(F.when(nonempty(old.columns, blanks), 1)).alias("n_old"))
    b = new.agg(F.count(F.when(nonempty(new.columns, blanks), 1)).alias("n_new"))
    lost = F.col("n_old") - F.col("n_new")
    both = a.select(F.col("n_old"), F.lit(0).cast("long").alias("n_new")).unionAll(b.select(F.lit(0).cast("long"), "n_new")).agg(F.sum("n_old").alias("n_old"), F.sum("n_new").alias("n_new"))
    return both.select((lost >= F.greatest(F.lit(5.0), F.lit(0.1) * F.col("n_old"))).alias("truncated"), "n_old", "n_new")


def missing_sheets(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sheets (pair_id, sheet) that one side lacks, both ways."""
    keys = ["pair_id", "sheet"]
    only = lambda a, b, side: a.join(b, keys, "left_anti").select(*keys, F.lit(side).alias("only_in"))
    return only(old, new, "old").unionAll(only(new, old, "new"))


def full_export(diff: DataFrame) -> DataFrame:
    """Every difference in one flat table, for Parquet or CSV."""
    fields = diff.schema["old"].dataType.names
    cells = [x for c in fields for x in (F.col(f"old.`{c}`").alias(f"old_{c}"), F.col(f"new.`{c}`").alias(f"new_{c}"))]
    return diff.select("status", "key", *cells, F.array_join("changed_cols", ",").alias("changed_cols"))
