"""Keyed comparison: rows of two snapshots matched by a canonical key.

Of rows that share a key, the first of each side is compared: the one with the least
order number, of equal numbers the least row; rows without a number come last. Further
copies matter only where the other side lacks the key.

First rows are found by pre-aggregated shuffles on the key. Rows of keys that hold more
than a share of all rows (every blank key is the same key) are told apart by heavy.py:
they stay where they lie and meet a broadcast table of those keys, at most a thousand,
and only the rest is shuffled. Rows travel as one struct, so no column of the data can
clash with the names used here.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.names import fresh
from ..functions.normalize import canonical, with_canonical
from .heavy import heavy_hashes, is_heavy

ORDER = "__rid"
KEY = "__key__"


def common_columns(old: DataFrame, new: DataFrame) -> list[str]:
    """Columns of both sides in OLD's order."""
    theirs = set(new.columns)
    return [c for c in dict.fromkeys(old.columns) if c in theirs and c != ORDER]


#: The place of rows without an order number: behind all others.
LAST = (1 << 63) - 1


def with_order(df: DataFrame, order: str | None) -> DataFrame:
    """df with ORDER: the named column, or a number that follows the files' order within one read."""
    if order is None:
        return df if ORDER in df.columns else df.withColumn(ORDER, F.monotonically_increasing_id())
    return df.withColumn(ORDER, F.col(f"`{order}`").cast("long"))


def with_key(df: DataFrame, keys: list[str], semantics: str = "v2") -> DataFrame:
    """df with the canonical key; several columns (names, or paths into structs) make a composite whose parts can't run into each other."""
    return _keyed(df, [F.col(f"`{k}`") for k in keys], semantics)


def _keyed(df: DataFrame, parts: list[Column], semantics: str) -> DataFrame:
    own = fresh([*df.columns, KEY], *(f"__k_{k}" for k in range(len(parts))))
    df = with_canonical(df, dict(zip(own, parts)), semantics)
    if len(own) == 1:
        return df.withColumnRenamed(own[0], KEY)
    escaped = [F.replace(F.replace(F.col(p), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")) for p in own]
    return df.withColumn(KEY, F.concat_ws("||", *escaped)).drop(*own)


def prepared(df: DataFrame, columns: list[str], keys: list[str], order: str | None, semantics: str) -> DataFrame:
    """Key, order and raw values of one side, all the comparison reads."""
    df = with_order(df, order)
    # Raw cells are columns of their own until the end, so that each is computed once and not wherever it is used.
    raw = [f"r{k}" for k in range(len(columns))]
    df = df.select(F.coalesce(F.col(ORDER), F.lit(LAST)).alias(ORDER), *[F.col(f"`{c}`").cast("string").alias(r) for r, c in zip(raw, columns)])
    df = _keyed(df, [F.col(raw[columns.index(k)]) for k in keys], semantics)
    return df.select(KEY, ORDER, F.struct(*[F.col(r).alias(c) for r, c in zip(raw, columns)]).alias("row"))


def first_rows(side: DataFrame) -> DataFrame:
    """One row per key: the first by order, and how many there are."""
    return side.groupBy(KEY).agg(F.min(F.struct(ORDER, "row")).alias("x"), F.count(F.lit(1)).alias("copies")).select(KEY, F.col(f"x.{ORDER}").alias(ORDER), F.col("x.row").alias("row"), "copies")


def with_changed(df: DataFrame, columns: list[str], keys: list[str], old: str = "old", new: str = "new", semantics: str = "v2") -> DataFrame:
    """df with changed_cols: names of columns whose canonical values differ; key columns are exempt.

    Only cells whose raw texts differ are brought to canonical form. The expression is
    small, so filters on it can move below joins and projections without growing.
    """
    differs = []
    for c in columns:
        if c not in keys:
            a, b = F.col(f"{old}.`{c}`"), F.col(f"{new}.`{c}`")
            differs.append(F.when(~a.eqNullSafe(b) & (canonical(a, semantics) != canonical(b, semantics)), F.lit(c)))
    return df.withColumn("changed_cols", F.array_compact(F.array(*differs)) if differs else F.array().cast("array<string>"))


class KeyedDiff:
    """The comparison of two snapshots by key; each view is a lazy DataFrame."""

    def __init__(self, old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None, semantics: str = "v2"):
        self.columns = common_columns(old, new)
        missing = [k for k in keys if k not in self.columns]
        if not keys or missing:
            raise ValueError(f"no key to compare by: {missing or 'none given'}")
        self.keys, self.semantics = list(keys), semantics
        self.old = prepared(old, self.columns, self.keys, order, semantics)
        self.new = prepared(new, self.columns, self.keys, order, semantics)
        self.old_only = [c for c in old.columns if c not in self.columns and c != ORDER]
        self.new_only = [c for c in new.columns if c not in self.columns and c != ORDER]

    def pairs(self) -> DataFrame:
        """First rows of keys on both sides: key, old, new, changed_cols (maybe empty), old_copies, new_copies."""
        return self._pairs(self.old, self.new)

    def _pairs(self, old: DataFrame, new: DataFrame) -> DataFrame:
        a = first_rows(old).select(KEY, F.col("row").alias("old"), F.col(ORDER).alias("old_rid"), F.col("copies").alias("old_copies"))
        b = first_rows(new).select(KEY, F.col("row").alias("new"), F.col(ORDER).alias("new_rid"), F.col("copies").alias("new_copies"))
        return with_changed(a.join(b, KEY), self.columns, self.keys, semantics=self.semantics)

    def changed(self) -> DataFrame:
        return self.pairs().where(F.size("changed_cols") > 0)

    @cached_property
    def heavy(self) -> list[int]:
        """Hashes of keys with so many rows that they are kept out of shuffles; found by a job of its own, once."""
        return heavy_hashes([self.old.select(KEY), self.new.select(KEY)], KEY)

    def _light(self, side: DataFrame) -> DataFrame:
        return side.where(~is_heavy(self.heavy, KEY)) if self.heavy else side

    def _lone(self, mine: DataFrame, theirs: DataFrame) -> DataFrame:
        """All rows of one side, copies included, whose key the other lacks."""
        keys = theirs.select(KEY)
        # An anti join would move below the union that a side may be; its smaller part then meets all keys in tasks sized by the few bytes of sorted keys.
        light = self._light(mine).join(self._light(keys).distinct().withColumn("there", F.lit(True)), KEY, "left").where("there IS NULL").drop("there")
        if not self.heavy:
            return light
        there = F.broadcast(keys.where(is_heavy(self.heavy, KEY)).distinct())  # a key per hash, collisions aside
        return light.unionByName(mine.where(is_heavy(self.heavy, KEY)).join(there, KEY, "left_anti"))

    def added(self) -> DataFrame:
        return self._lone(self.new, self.old)

    def removed(self) -> DataFrame:
        return self._lone(self.old, self.new)

    def key_table(self) -> DataFrame:
        """Per key: its rows on each side, and the least order number of each; one pre-aggregated shuffle for both sides."""
        one = lambda df, is_old: df.select(KEY, F.when(F.lit(is_old), F.col(ORDER)).alias("o"), F.when(F.lit(not is_old), F.col(ORDER)).alias("n"), F.lit(int(is_old)).alias("is_old"))
        both = one(self.old, True).unionAll(one(self.new, False))
        return both.groupBy(KEY).agg(F.sum("is_old").alias("n_old"), F.sum(1 - F.col("is_old")).alias("n_new"), F.min("o").alias("old_rid"), F.min("n").alias("new_rid"))

    def _differences(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """(status, KEY, rid, old, new, changed_cols) of rows that are shuffled by key.

        The rows of both sides are shuffled once and sorted within their key, NEW before OLD: all rows of keys that one
        side lacks stay, and of the others NEW's first row, which then has OLD's first row beside it.
        """
        rows = old.select("*", F.lit(True).alias("is_old")).unionByName(new.select("*", F.lit(False).alias("is_old")))
        by_side = Window.partitionBy(KEY).orderBy("is_old", ORDER, "row")  # of equal order numbers the least row
        whole = by_side.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        first_old = F.first(F.when(F.col("is_old"), F.struct(ORDER, "row")), ignorenulls=True)
        met = rows.select("*", F.count_if("is_old").over(whole).alias("n_old"), F.count_if(~F.col("is_old")).over(whole).alias("n_new"), first_old.over(whole).alias("first_old"), F.row_number().over(by_side).alias("place"))
        lone = (F.col("n_old") == 0) | (F.col("n_new") == 0)
        a, b = F.when(F.col("n_new") == 0, F.col("row")).otherwise(F.col("first_old.row")), F.when(F.col("n_new") > 0, F.col("row"))
        rid = F.when(lone, F.col(ORDER)).otherwise(F.col(f"first_old.{ORDER}"))
        both = met.where(lone | (F.col("place") == 1)).select(KEY, "n_old", "n_new", rid.alias("rid"), a.alias("old"), b.alias("new"))
        both = with_changed(both, self.columns, self.keys, semantics=self.semantics)
        status = F.when(F.col("n_old") == 0, "added").when(F.col("n_new") == 0, "removed").when(F.size("changed_cols") > 0, "changed")
        return both.withColumn("status", status).where(F.col("status").isNotNull()).select("status", KEY, "rid", "old", "new", "changed_cols")

    def _heavy_differences(self) -> DataFrame:
        """The same of heavy keys: first rows by partial aggregation, lone rows by broadcast, so no row of them is shuffled by key."""
        only = lambda side: side.where(is_heavy(self.heavy, KEY))
        pairs = self._pairs(only(self.old), only(self.new)).where(F.size("changed_cols") > 0)
        changed = pairs.select(F.lit("changed").alias("status"), KEY, F.col("old_rid").alias("rid"), "old", "new", "changed_cols")
        none = F.lit(None).cast(self.old.schema["row"].dataType)
        keys = lambda side: F.broadcast(only(side).select(KEY).distinct())
        added, removed = only(self.new).join(keys(self.old), KEY, "left_anti"), only(self.old).join(keys(self.new), KEY, "left_anti")
        lone = lambda df, status, old, new: df.select(F.lit(status).alias("status"), KEY, F.col(ORDER).alias("rid"), old.alias("old"), new.alias("new"), F.array().cast("array<string>").alias("changed_cols"))
        return changed.unionByName(lone(added, "added", none, F.col("row"))).unionByName(lone(removed, "removed", F.col("row"), none))

    def result(self) -> DataFrame:
        """All differences: status, key, rid, old, new, changed_cols; rid is null for rows without an order number."""
        found = self._differences(self._light(self.old), self._light(self.new))
        if self.heavy:
            found = found.unionByName(self._heavy_differences())
        none = F.array().cast("array<string>")
        rid = F.when(F.col("rid") != LAST, F.col("rid")).alias("rid")
        return found.select("status", F.col(KEY).alias("key"), rid, "old", "new", F.when(F.col("status") == "changed", F.col("changed_cols")).otherwise(none).alias("changed_cols"))

    def status(self) -> DataFrame:
        """A status for every key in one full join: key, status (changed, same, added, removed), n_old, n_new."""
        a = first_rows(self.old).select(KEY, F.col("row").alias("old"), F.col("copies").alias("n_old"))
        b = first_rows(self.new).select(KEY, F.col("row").alias("new"), F.col("copies").alias("n_new"))
        both = with_changed(a.join(b, KEY, "full"), self.columns, self.keys, semantics=self.semantics)
        differs = F.size("changed_cols") > 0
        status = F.when(F.col("n_old").isNull(), "added").when(F.col("n_new").isNull(), "removed").when(differs, "changed").otherwise("same")
        return both.select(F.col(KEY).alias("key"), status.alias("status"), F.coalesce("n_old", F.lit(0)).alias("n_old"), F.coalesce("n_new", F.lit(0)).alias("n_new"))

    def duplicate_keys(self) -> DataFrame:
        """Keys with several rows on a side; only their first rows are compared."""
        return self.key_table().where((F.col("n_old") > 1) | (F.col("n_new") > 1)).select(F.col(KEY).alias("key"), "n_old", "n_new")

    def column_report(self) -> DataFrame:
        """Columns that only one side has."""
        spark = self.old.sparkSession
        return spark.createDataFrame([(c, "old") for c in self.old_only] + [(c, "new") for c in self.new_only], "column string, side string")
