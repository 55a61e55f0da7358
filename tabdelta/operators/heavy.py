"""Heavy keys, found by a sketch of bounded size, so that joins can treat them apart.

A join deals rows by key, and all rows of one key meet in one task; adaptive execution
splits such a task only between two plain shuffles, not where a side is an aggregate.
So keys that hold more than a ``SHARE``th of the rows are found first, by Spark's
frequent-items sketch (mergeable counters in the manner of Misra and Gries): partial
sketches per task, a few kilobytes merged. Its counters are ten times as many as there
can be such keys, so every one of them is among those found. Rows of heavy keys are then
decided where they lie, against a small table of those keys; the rest is shuffled.

Results don't depend on what is found: a key may be on either side of the split. Keys
are told by 64-bit hashes, so a key that shares a heavy one's hash is taken along.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

SHARE = 1000
#: Rows below which a key is no burden for a task.
LEAST_ROWS = 100_000
_COUNTERS = 10 * SHARE


def key_hash(*cols: str | Column) -> Column:
    return F.xxhash64(*cols)


def _fits_one_task(frames: list[DataFrame]) -> bool:
    """Whether Spark knows the frames to be smaller than one partition of a shuffle."""
    spark = frames[0].sparkSession
    advised = spark._jsparkSession.sessionState().conf().getConf(spark._jvm.org.apache.spark.sql.internal.SQLConf.ADVISORY_PARTITION_SIZE_IN_BYTES())
    return sum(int(str(f._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for f in frames) <= advised


def most_varied(*sides: DataFrame) -> int:
    """The number of the column, by position, with the most distinct raw values in all sides, about; the first where one task holds them anyway."""
    if _fits_one_task([*sides]):
        return 0
    found = reduce(DataFrame.unionAll, sides).agg(*[F.approx_count_distinct(f"`{c}`") for c in sides[0].columns]).first()
    return max(range(len(found)), key=found.__getitem__)


def heavy_hashes(keys: list[DataFrame], *cols: str, least: int | None = None) -> list[int]:
    """Hashes of at most SHARE keys: all that hold more than a SHAREth of the rows of all frames and ``least`` rows.

    Frames that Spark knows to be smaller than one partition of a shuffle aren't counted: one task holds them anyway.
    """
    least = LEAST_ROWS if least is None else least
    if _fits_one_task(keys):
        return []
    hashed = reduce(DataFrame.unionAll, (k.select(key_hash(*cols).alias("h")) for k in keys))
    found = hashed.agg(F.expr(f"approx_top_k(h, {SHARE}, {_COUNTERS})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    return sorted(x["item"] for x in found.top or [] if x["count"] > max(least, found.n // SHARE))


def is_heavy(hashes: list[int], *cols: str) -> Column:
    return key_hash(*cols).isin(hashes) if hashes else F.lit(False)


def meet(rows: DataFrame, values: DataFrame, on: list[str], hot: list[int]) -> DataFrame:
    """rows joined with a table of distinct values; rows of the heavy ones stay where they are."""
    if not hot:
        return rows.join(values, on)
    heavy = is_heavy(hot, *on)
    return rows.where(~heavy).join(values.where(~heavy), on).unionByName(rows.where(heavy).join(F.broadcast(values.where(heavy)), on))
