"""Comparison without a key: rows as values.

A value is all canonical cells of a row, each with its length, so no separator can make
different rows look alike. Values are told by their SHA-256 digest: 32 bytes are
sorted and compared instead of all cells. The rows asked for and the digests of the
others go through one shuffle and are counted where they meet, so each row is brought to
canonical form once. Rows of values that very many rows share (heavy.py) meet their
counts by broadcast and aren't shuffled, so no task gets all copies of one.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.normalize import with_canonical
from .heavy import heavy_hashes, is_heavy, most_varied
from .keyed import ORDER, common_columns, with_order


def valued(df: DataFrame, columns: list[str], order: str | None, semantics: str) -> DataFrame:
    """Every row with its value, a struct of canonical cells, and the value's digest."""
    df = with_order(df, order)
    shown = [c for c in df.columns if c != ORDER]
    # Raw cells are columns of their own until the end, so that each is computed once and not wherever it is used.
    raw = df.select(ORDER, *[F.col(f"`{c}`").cast("string").alias(f"r{k}") for k, c in enumerate(shown)])
    named = {f"v{k}": F.col(f"r{shown.index(c)}") for k, c in enumerate(columns)}
    done = with_canonical(raw, named, semantics)
    row = F.struct(*[F.col(f"r{k}").alias(c) for k, c in enumerate(shown)]).alias("row")
    # By a lambda, and so in a projection of its own: in one with the cells the generated method is too long for the JVM to compile.
    cells = F.array_join(F.transform(F.array(*named), lambda v: F.concat(F.length(v).cast("string"), F.lit(":"), v)), "")
    # Never null, and known to be: else every join on it would filter by the whole expression.
    digest = F.coalesce(F.unhex(F.sha2(cells if named else F.lit(""), 256)), F.lit(b""))
    return done.select(ORDER, row, F.struct(*named).alias("value"), digest.alias("digest"))


class KeylessDiff:
    """``added`` and ``removed`` rows of two snapshots.

    multiset: ``count`` returns every copy of a row whose number grew or shrank (the
    default), ``set`` ignores numbers and compares columns by position, and ``exact``
    returns just the surplus copies.
    """

    def __init__(self, old: DataFrame, new: DataFrame, multiset: str = "count", order: str | None = None, semantics: str | None = None):
        if multiset not in ("count", "set", "exact"):
            raise ValueError(f"unknown multiset mode {multiset!r}")
        self.multiset = multiset
        semantics = semantics or ("v1" if multiset == "set" else "v2")
        own = lambda df: [c for c in df.columns if c != ORDER]
        if multiset == "set":
            left, right = own(old), own(new)
            self.comparable = len(left) == len(right)
        else:
            left = right = common_columns(old, new)
            self.comparable = bool(left)
        self.columns, self.semantics = left, semantics
        self._raw = [df.select([F.col(f"`{c}`").cast("string").alias(f"c{k}") for k, c in enumerate(cs)]) for df, cs in ((old, left), (new, right))]
        self.old, self.new = valued(old, left, order, semantics), valued(new, right, order, semantics)

    @cached_property
    def heavy(self) -> list[int]:
        """Hashes of values with so many rows that they are kept out of shuffles; found once, by jobs of their own.

        A heavy value has a heavy cell in every column, so one column is looked at first, and whole values only among
        the rows of its heavy cells.
        """
        if not self.columns:
            return heavy_hashes([self.old.select("digest"), self.new.select("digest")], "digest")
        k = most_varied(*self._raw)
        cells = heavy_hashes([with_canonical(side.select(F.col(f"c{k}").alias("c")), {"v": F.col("c")}, self.semantics).select("v") for side in self._raw], "v")
        return heavy_hashes([side.where(is_heavy(cells, f"value.v{k}")).select("digest") for side in (self.old, self.new)], "digest") if cells else []

    def _kept(self, rows: DataFrame, digests: list[DataFrame], keep: Column) -> DataFrame:
        """The rows whose values have numbers of copies, n_old and n_new, that satisfy ``keep``.

        ``rows`` have their ``digest`` and ``is_old``, ``digests`` are these alone of the rows that count but aren't asked for.
        Each row is made and shuffled once and counted where all of its value lie; heavy values are counted by partial
        aggregation, and their rows stay where they are.
        """
        shown = [c for c in rows.columns if c not in ("digest", "is_old")]
        all_rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (d.withColumn("asked", F.lit(False)) for d in digests), rows.withColumn("asked", F.lit(True)))
        hot, copies = is_heavy(self.heavy, "digest"), Window.partitionBy("digest")
        n_old, n = F.sum(F.col("is_old").cast("int")), F.count(F.lit(1))
        light = all_rows.where(~hot) if self.heavy else all_rows
        light = light.select("*", n_old.over(copies).alias("n_old"), n.over(copies).alias("n")).withColumn("n_new", F.col("n") - F.col("n_old"))
        light = light.where("asked").where(keep).select(shown)
        if not self.heavy:
            return light
        sides = reduce(DataFrame.unionByName, digests, rows.select("digest", "is_old"))
        counts = sides.where(hot).groupBy("digest").agg(n_old.alias("n_old"), n.alias("n")).withColumn("n_new", F.col("n") - F.col("n_old"))
        met = rows.where(hot).join(F.broadcast(counts), "digest").where(keep)  # a row per heavy value
        return light.unionByName(met.select(shown))

    def counts(self) -> DataFrame:
        """Per value: its copies on each side, where they differ; one pre-aggregated shuffle for both sides."""
        both = self.old.select("digest", F.lit(1).alias("o"), F.lit(0).alias("n")).unionAll(self.new.select("digest", F.lit(0), F.lit(1)))
        return both.groupBy("digest").agg(F.sum("o").alias("n_old"), F.sum("n").alias("n_new")).where("n_old != n_new")

    def _side(self, mine: DataFrame, theirs: DataFrame, grew: Column, gone: Column) -> DataFrame:
        if not self.comparable:
            return mine.select(ORDER, "row") if self.multiset == "set" else mine.select(ORDER, "row").limit(0)
        if self.multiset == "exact":
            surplus = mine.select("value").exceptAll(theirs.select("value"))
            return surplus.select(F.struct(*[F.col(f"value.v{k}").alias(c) for k, c in enumerate(self.columns)]).alias("row"))
        is_old = F.lit(mine is self.old).alias("is_old")
        return self._kept(mine.select(ORDER, "row", "digest", is_old), [theirs.select("digest", (~is_old).alias("is_old"))], grew if self.multiset == "count" else gone)

    def added(self) -> DataFrame:
        return self._side(self.new, self.old, F.col("n_new") > F.col("n_old"), F.col("n_old") == 0)

    def removed(self) -> DataFrame:
        return self._side(self.old, self.new, F.col("n_old") > F.col("n_new"), F.col("n_new") == 0)

    def both(self) -> DataFrame:
        """Added and removed rows in one: status, ORDER and a struct of the compared columns.

        In ``count`` mode the rows of both sides are shuffled and counted together.
        """
        cut = lambda df, status: df.select(F.lit(status).alias("status"), ORDER, F.struct(*[F.col(f"row.`{c}`").alias(c) for c in self.columns]).alias("row"), *(["digest"] if "digest" in df.columns else []))
        if self.multiset != "count" or not self.comparable:
            return cut(self.added(), "added").unionByName(cut(self.removed(), "removed"))
        rows = cut(self.new, "added").withColumn("is_old", F.lit(False)).unionByName(cut(self.old, "removed").withColumn("is_old", F.lit(True)))
        return self._kept(rows, [], F.when(F.col("is_old"), F.col("n_old") > F.col("n_new")).otherwise(F.col("n_new") > F.col("n_old")))
