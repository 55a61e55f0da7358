"""The assignment of a component too large for one task: removed rows take turns, a bounded number at a time.

The rule is serial: each removed row, in order, takes the best free added row. What a turn needs is
small, though. Rows meet in places (the values of a set of columns, or a removed node's partners of one
ratio), and of a place a turn of few removed rows can hardly take more than some of its first free rows.
So Spark joins the places of the turn's rows with the free added rows, keeps of each place the first
few, and one task walks through the turn with these lists. A list that was cut says so: when it runs
out and a row behind the cut might have been the one to take, the walk stops there, and the next turn
begins with that row and longer lists. The rows decided are final, nothing is a guess. A task holds
the lists of one turn, whatever the size of the component; no pair of rows is listed in full.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .staging import staged

#: Removed rows of a turn, and rows of a place beyond those that the turn's own rows could take.
AT_ONCE, SPARE = 200_000, 16
LISTED, CUT, TURN = 0, 1, 2
PLACES = "array<struct<size:double,p:bigint,q:bigint>>"


def take_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ri, ai) of the turn's rows, ai null for those that find nothing, up to the first that can't be decided.

    Entries (kind, p, q, id, places) come sorted by kind, p, q and id: the free rows of places, then which places were
    cut, then the removed rows with theirs.
    """
    lists: dict[tuple[int, int], array] = {}
    at: dict[tuple[int, int], int] = {}
    cut: set[tuple[int, int]] = set()
    taken: set[int] = set()
    stopped = False

    def first(place: tuple[int, int]) -> int | None:
        mine = lists.get(place, ())
        k = at.get(place, 0)
        while k < len(mine) and mine[k] in taken:
            k += 1
        at[place] = k
        return mine[k] if k < len(mine) else None

    for batch in batches:
        out_r, out_a = [], []
        for kind, p, q, rid, places in zip(*(c.to_pylist() for c in batch.columns)):
            if stopped:
                break
            if kind == LISTED:
                lists.setdefault((p, q), array("q")).append(rid)
                continue
            if kind == CUT:
                cut.add((p, q))
                continue
            by_size: dict[float, list] = {}
            for x in places:
                by_size.setdefault(x["size"], []).append((x["p"], x["q"]))
            best = None
            for size in sorted(by_size, reverse=True):
                found = [(place, first(place)) for place in by_size[size]]
                best = min((ai for _, ai in found if ai is not None), default=None)
                if any(ai is None and place in cut and (best is None or best > lists[place][-1]) for place, ai in found):
                    stopped = True
                    break
                if best is not None:
                    taken.add(best)
                    break
            if stopped:
                break
            out_r.append(rid)
            out_a.append(best)
        yield pa.RecordBatch.from_arrays([pa.array(out_r, pa.int64()), pa.array(out_a, pa.int64())], names=["ri", "ai"])


def in_turns(removed: DataFrame, added: DataFrame, removed_places: Callable[[DataFrame], DataFrame], added_places: Callable[[DataFrame], DataFrame], at_once: int | None = None) -> DataFrame:
    """(ri, ai): the assignment of the rows ``removed`` and ``added``, which have an ``id`` each.

    ``removed_places`` gives (id, places) and ``added_places`` (id, p, q) of some of the rows; places of falling size are
    tried in turn, of those of one size the first free row of all counts, and (p, q) names a place.
    """
    at_once = AT_ONCE if at_once is None else at_once
    n = removed.count()
    shares = [k * at_once / n for k in range(1, -(-n // at_once))]
    ends = removed.agg(F.percentile_approx("id", shares, 10_000)).first()[0] if shares else []  # an id per turn
    last = removed.agg(F.max("id")).first()[0]
    decided, below = [], None
    for end in sorted({*ends, last} - {None}):
        times = 2
        while True:
            rows = removed.where(F.col("id") <= end) if below is None else removed.where((F.col("id") > below) & (F.col("id") <= end))
            turn = staged(removed_places(rows).select("id", F.col("places").cast(PLACES).alias("places")))
            count = turn.count()
            if not count:
                break
            wanted = turn.select(F.explode("places").alias("x")).groupBy("x.p", "x.q").agg((F.count(F.lit(1)) * times + SPARE).alias("most"))
            free = added
            for d in decided:
                free = free.join(d.select(F.col("ai").alias("id")).where("id IS NOT NULL"), "id", "left_anti")
            ranked = added_places(free).join(wanted, ["p", "q"]).withColumn("rank", F.row_number().over(Window.partitionBy("p", "q").orderBy("id"))).where("rank <= most + 1")
            none = F.lit(None).cast(PLACES).alias("places")
            listed = ranked.select(F.when(F.col("rank") <= F.col("most"), LISTED).otherwise(CUT).alias("kind"), "p", "q", "id", none)
            entries = listed.unionByName(turn.select(F.lit(TURN).alias("kind"), F.col("id").alias("p"), F.lit(0).cast("long").alias("q"), "id", "places"))
            done = staged(entries.repartition(1).sortWithinPartitions("kind", "p", "q", "id").mapInArrow(take_turn, "ri long, ai long"))
            so_far = done.agg(F.count(F.lit(1)), F.max("ri")).first()
            if so_far[0]:
                decided.append(done)
                below = so_far[1]
            if so_far[0] == count:
                break
            times *= 2
        below = end
        if len(decided) > 8:  # one table again, so that the plan of a turn doesn't grow with the turns before
            whole = decided[0]
            for d in decided[1:]:
                whole = whole.unionAll(d)
            decided = [staged(whole)]
    out = removed.sparkSession.createDataFrame([], "ri long, ai long")
    for d in decided:
        out = out.unionAll(d)
    return out.where("ai IS NOT NULL")
