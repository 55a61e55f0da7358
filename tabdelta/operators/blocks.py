"""One-to-one assignment of like rows from distinct rows, without listing the pairs of rows.

The rule is that of ``reconcile``: removed rows, in order, each take the most similar free added row,
of equals the first. Three things keep what is listed small.

* Columns that are constant over both sides make every pair equal there. They are counted and left
  out; ``need`` is what a pair must still share of the others. Where that is 0 or less every pair
  qualifies, and the pairs that share nothing else are one queue of all added rows, not a list.
* Equal rows are one node. Rows of a node are alike to every other row, so the rule takes them in
  order: a node is its rows and the place of the next free one.
* What a node may take is a number of queues by falling similarity, each a heap of added nodes by
  their next free row. Queues come from either of two exact sources, whichever lists less by an
  exact count taken beforehand: the pairs of nodes (found by their rarest tokens), one queue for each
  removed node and similarity; or blocks, one queue for each set of columns and the values there,
  shared by all rows that hold them. A pair that shares s cells meets in a block of s columns, and
  once no larger block has a free row, the rows of the blocks of s columns share exactly s.

The rule decomposes by connected component. Components are labelled in Spark and dealt to tasks; a
task holds the nodes and queues of one component at a time and streams through its removed rows. A
component with more than ``giant`` entries goes through ``turns``: a bounded number of removed rows
at a time, with the first free rows of the queues they may choose from.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Callable, Iterator
from heapq import heappop, heapreplace
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.normalize import with_canonical
from .components import components
from .heavy import heavy_hashes, meet
from .reconcile import GIANT, packed
from .staging import staged
from .turns import in_turns

#: Longer cells are told by their SHA-256, which has 64 characters and so meets no shorter cell.
LONGEST = 63
ADDED, PAIR, REMOVED = 0, 1, 2


class Component:
    """The added nodes of a component and the queues over them."""

    def __init__(self, subsets: list[tuple[int, ...]] | None, all_qualify: bool):
        self.subsets, self.all_qualify = subsets, all_qualify
        self.ids: dict[int, array] = {}
        self.next: dict[int, int] = {}
        self.blocks: dict[tuple, list] = {}
        self.codes: dict[tuple[int, str], int] = {}
        self.everything: list[tuple[int, int]] = []
        self.tiers: dict[int, list[list[list]]] = {}

    def _keys(self, cells: list[str]) -> Iterator[tuple]:
        codes = [self.codes.setdefault((k, v), len(self.codes)) for k, v in enumerate(cells)]
        return ((len(s), *[codes[k] for k in s]) for s in self.subsets)

    def add(self, ai: int, node: int, cells: list[str] | None) -> None:
        """An added row; rows come by rising ai, so what is appended keeps every queue a heap."""
        if node not in self.ids:
            self.ids[node], self.next[node] = array("q"), 0
            entry = (ai, node)
            if self.subsets is not None:
                for key in self._keys(cells):
                    self.blocks.setdefault(key, []).append(entry)
            elif self.all_qualify:
                self.everything.append(entry)
        self.ids[node].append(ai)

    def pair(self, node: int, other: int, n: float) -> None:
        """A pair of an added and a removed node; pairs come by falling n and then rising added node."""
        tiers = self.tiers.setdefault(other, [])
        if not tiers or tiers[-1][0] != n:
            tiers.append((n, [[]]))
        tiers[-1][1][0].append((node, node))

    def _first(self, queue: list[tuple[int, int]]) -> tuple[int, int] | None:
        """The next free row of a queue and its node, None when there is none left."""
        while queue:
            ai, node = queue[0]
            ids, at = self.ids[node], self.next[node]
            if at == len(ids):
                heappop(queue)
            elif ids[at] != ai:
                heapreplace(queue, (ids[at], node))
            else:
                return queue[0]
        return None

    def take(self, node: int, cells: list[str] | None) -> int | None:
        """The added row that the next row of a removed node takes; its cells come with the node's first row."""
        if self.subsets is not None and node not in self.tiers:
            by_size: dict[int, list] = {}
            for key in self._keys(cells):
                if key in self.blocks:
                    by_size.setdefault(key[0], []).append(self.blocks[key])
            self.tiers[node] = sorted(by_size.items(), reverse=True)
        tiers = self.tiers.get(node, [])
        while tiers:
            found = [(first, q) for q in tiers[0][1] if (first := self._first(q))]
            if found:
                tiers[0] = (tiers[0][0], [q for _, q in found])
                return self._taken(min(found)[0])
            tiers.pop(0)  # a queue without a free row never gets one again
        return self._taken(self._first(self.everything))

    def _taken(self, first: tuple[int, int] | None) -> int | None:
        if first is None:
            return None
        self.next[first[1]] += 1
        return first[0]


def walk(subsets: list[tuple[int, ...]] | None, all_qualify: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rule over the entries of whole components, sorted by label, kind, falling n, id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part = None, None
        for batch in batches:
            out_r, out_a = [], []
            for label, kind, n, rid, node, cells in zip(*(c.to_pylist() for c in batch.columns)):
                if part is None or label != now:
                    now, part = label, Component(subsets, all_qualify)
                if kind == ADDED:
                    part.add(rid, node, cells)
                elif kind == PAIR:
                    part.pair(rid, node, n)
                elif (ai := part.take(node, cells)) is not None:
                    out_r.append(rid)
                    out_a.append(ai)
            yield pa.RecordBatch.from_arrays([pa.array(out_r, pa.int64()), pa.array(out_a, pa.int64())], names=["ri", "ai"])

    return run


class Nodes:
    """A side as nodes (node, cells) and rows (id, node); a node has the least id of its rows."""

    def __init__(self, rows: DataFrame, hot: list[int]):
        self.nodes = staged(rows.groupBy("cells").agg(F.min("id").alias("node")))
        self.rows = staged(meet(rows, self.nodes, ["cells"], hot).select("id", "node"))

    def tokens(self) -> DataFrame:
        return self.nodes.select("node", F.posexplode("cells").alias("c", "v"))


def _rarest(r: Nodes, a: Nodes, prefix: int) -> tuple[DataFrame, DataFrame]:
    """(node, c, v) of both sides: the ``prefix`` rarest tokens of each node in an order that both share."""
    tokens = [r.tokens(), a.tokens()]
    seen = staged(tokens[0].unionAll(tokens[1]).groupBy("c", "v").agg(F.count(F.lit(1)).alias("freq")))
    hot = heavy_hashes([t.select("c", "v") for t in tokens], "c", "v")
    out = []
    for t in tokens:
        ranked = meet(t, seen, ["c", "v"], hot).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("freq", "c", "v"))).alias("t"))  # a node has a token per column
        out.append(staged(ranked.select("node", F.explode(F.slice("t", 1, prefix)).alias("t")).select("node", "t.c", "t.v")))
    return out[0], out[1]


def _pairs(r: Nodes, a: Nodes, rare: tuple[DataFrame, DataFrame], n_columns: int, least: int) -> DataFrame:
    """(rn, an, n): pairs of nodes with at least ``least`` equal cells."""
    met = rare[0].withColumnRenamed("node", "rn").join(rare[1].withColumnRenamed("node", "an"), ["c", "v"]).select("rn", "an").distinct()
    both = met.join(r.nodes.toDF("rc", "rn"), "rn").join(a.nodes.toDF("ac", "an"), "an")
    equal = sum(((F.col("rc")[k] == F.col("ac")[k]).cast("int") for k in range(n_columns)), F.lit(0))
    return both.select("rn", "an", equal.alias("n")).where(F.col("n") >= least)


def _name(side: int, node: str = "node"):
    return F.xxhash64(F.lit(side), node)


def _block_edges(r: Nodes, a: Nodes, sets: list[tuple[int, ...]]) -> DataFrame:
    """(u, v): nodes and the blocks of ``need`` columns they share with a node of the other side."""
    blocks = F.explode(F.array(*[F.xxhash64(F.lit(i), *[F.col("cells")[k] for k in s]) for i, s in enumerate(sets)])).alias("v")
    held = staged(r.nodes.select(_name(REMOVED).alias("u"), F.lit(REMOVED).alias("side"), blocks).unionAll(a.nodes.select(_name(ADDED).alias("u"), F.lit(ADDED).alias("side"), blocks)))
    shared = held.groupBy("v").agg(F.min("side").alias("lo"), F.max("side").alias("hi")).where("lo != hi").select("v")
    return meet(held.select("u", "v"), shared, ["v"], heavy_hashes([held.select("v")], "v"))


def linked(pairs: DataFrame) -> DataFrame:
    """(u, v): edges that connect the same nodes as the pairs (rn, an), but few where pairs are dense.

    Each removed node is tied to its least partner, and its other partners to that one too; removed nodes with the same
    least partner mostly repeat those edges, which partial aggregation drops where they arise.
    """
    least = pairs.groupBy("rn").agg(F.min("an").alias("m"))
    others = pairs.join(least, "rn").where("an != m").select("an", "m").distinct()
    return least.select(_name(REMOVED, "rn").alias("u"), _name(ADDED, "m").alias("v")).unionAll(others.select(_name(ADDED, "an"), _name(ADDED, "m")))


def dealt_entries(r: Nodes, a: Nodes, pairs: DataFrame | None, edges: DataFrame | None, n_sets: int = 0, giant: int = GIANT) -> tuple[DataFrame, DataFrame | None]:
    """Entries (label, kind, n, id, node, cells) for ``walk``, whole components to a task each, and those of components with over ``giant`` of them.

    ``edges`` (u, v) connect the nodes, None where all are one component. ``n_sets`` is the number of blocks of a node, 0 where there are ``pairs``.
    The cells go with the first row of a node, and only to blocks.
    """
    labels = None if edges is None else staged(components(edges))
    hot = [] if edges is None else heavy_hashes([s.rows.select("node") for s in (r, a)], "node")
    one = F.lit(0).cast("long")

    def labelled(side: Nodes, kind: int) -> DataFrame:
        known = side.nodes.withColumn("label", one) if edges is None else side.nodes.join(labels.toDF("of", "label"), _name(kind) == F.col("of")).drop("of")
        cells = F.when(F.col("id") == F.col("node"), F.col("cells")) if n_sets else F.lit(None).cast("array<string>")
        return meet(side.rows, known, ["node"], hot).select("label", F.lit(kind).alias("kind"), F.lit(0.0).alias("n"), "id", "node", cells.alias("cells"))

    entries = labelled(a, ADDED).unionAll(labelled(r, REMOVED))
    if pairs is not None:
        of = pairs.withColumn("label", one) if edges is None else pairs.join(labels.toDF("of", "label"), _name(ADDED, "an") == F.col("of"))
        entries = entries.unionAll(of.select("label", F.lit(PAIR), F.col("n").cast("double"), F.col("an"), F.col("rn"), F.lit(None).cast("array<string>")))
    weight = F.when(F.col("cells").isNotNull(), n_sets).otherwise(1).cast("long")
    large = [x.label for x in entries.groupBy("label").agg(F.sum(weight).alias("w")).where(F.col("w") > giant).select("label").collect()]  # one per ``giant`` entries at most
    dealt = entries.where(~F.col("label").isin(large)) if large else entries
    dealt = dealt.repartition("label").sortWithinPartitions("label", "kind", F.desc("n"), "id")
    return dealt, entries.where(F.col("label").isin(large)) if large else None


def match_rows(removed: DataFrame, added: DataFrame, columns: list[str], threshold: float = 0.5, semantics: str = "v2", giant: int = GIANT, source: str | None = None, at_once: int | None = None) -> DataFrame:
    """(ri, ai): the one-to-one assignment of all rows with at least ``threshold`` of the columns equal.

    Sides are as for ``candidate_pairs``; ids are unique integers. No columns, or a side without rows, give no rows.
    ``source`` sets where queues come from, "pairs" or "blocks"; by default it is what lists less. ``at_once`` is the number
    of removed rows of a turn in components with over ``giant`` entries.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be positive")
    spark = removed.sparkSession
    nothing = spark.createDataFrame([], "ri long, ai long")
    if not columns:
        return nothing
    removed, added = packed(removed, "ri", columns), packed(added, "ai", columns)
    tmp = [f"c{k}" for k in range(len(columns))]

    def canonical(df: DataFrame, rid: str) -> DataFrame:
        wide = with_canonical(df, {t: F.col(f"row.`{c}`") for t, c in zip(tmp, columns)}, semantics)
        return staged(wide.select(F.col(rid).cast("long").alias("id"), *[F.when(F.length(t) > LONGEST, F.sha2(t, 256)).otherwise(F.col(t)).alias(t) for t in tmp]))

    sides = canonical(removed, "ri"), canonical(added, "ai")
    ends = sides[0].unionAll(sides[1]).agg(*[(F.min(t) != F.max(t)).alias(t) for t in tmp]).first()
    if any(s.isEmpty() for s in sides):
        return nothing
    varying = [t for t in tmp if ends[t]]
    m, need = len(varying), max(1, math.ceil(threshold * len(columns) - 1e-12)) - (len(columns) - len(varying))
    rows = [s.select("id", (F.array(*varying) if varying else F.array().cast("array<string>")).alias("cells")) for s in sides]
    hot = heavy_hashes([s.select("cells") for s in rows], "cells")
    r, a = Nodes(rows[0], hot), Nodes(rows[1], hot)

    all_qualify, least = need <= 0, max(1, need)
    n_nodes = r.nodes.count() + a.nodes.count()
    n_sets = sum(math.comb(m, s) for s in range(max(0, need), m + 1))
    rare = None
    if source is None:
        rare = _rarest(r, a, m - least + 1) if m else None
        by_token = [t.groupBy("c", "v").agg(F.count(F.lit(1)).cast("double").alias(n)) for t, n in zip(rare or (), ("fr", "fa"))]
        met = by_token[0].join(by_token[1], ["c", "v"]).agg(F.sum(F.col("fr") * F.col("fa"))).first()[0] or 0.0 if rare else 0.0
        source = "blocks" if n_sets * n_nodes < met else "pairs"
    if source == "blocks":
        subsets = [s for size in range(m, max(0, need) - 1, -1) for s in combinations(range(m), size)]
        pairs = None
        edges = None if all_qualify else _block_edges(r, a, list(combinations(range(m), need)))
    else:
        subsets = None
        pairs = staged(_pairs(r, a, rare or _rarest(r, a, m - least + 1), m, least)) if m else spark.createDataFrame([], "rn long, an long, n int")
        edges = None if all_qualify else linked(pairs)

    dealt, large = dealt_entries(r, a, pairs, edges, n_sets if subsets is not None else 0, giant)
    done = dealt.mapInArrow(walk(subsets, all_qualify), "ri long, ai long")
    if large is None:
        return done
    return done.unionByName(large_matches(large, r, a, pairs, subsets, all_qualify, at_once))


def large_matches(large: DataFrame, r: Nodes, a: Nodes, pairs: DataFrame | None, subsets: list[tuple[int, ...]] | None, all_qualify: bool, at_once: int | None = None) -> DataFrame:
    """(ri, ai) of components that are too large for a task, from their ``large`` entries.

    Places are blocks, told by a 128-bit hash of their columns and values, or the partners of a removed node of one n.
    """
    rows = {kind: staged(large.where(F.col("kind") == kind).select("id", "node")) for kind in (REMOVED, ADDED)}
    if subsets is not None:
        rows = {kind: staged(meet(rows[kind], side.nodes, ["node"], heavy_hashes([rows[kind].select("node")], "node")).select("id", "cells")) for kind, side in ((REMOVED, r), (ADDED, a))}
        place = lambda s: [F.xxhash64(F.lit(seed), F.lit(str(s)), *[F.col("cells")[k] for k in s]).alias(name) for seed, name in ((1, "p"), (2, "q"))]
        places = F.array(*[F.struct(F.lit(float(len(s))).alias("size"), *place(s)) for s in subsets])
        return in_turns(rows[REMOVED], rows[ADDED], lambda df: df.select("id", places.alias("places")), lambda df: df.select("id", F.explode(places).alias("x")).select("id", "x.p", "x.q"), at_once)
    of = staged(pairs.select("rn", "an", F.col("n").cast("double").alias("size"), F.xxhash64(F.col("n").cast("double")).alias("q")))  # q tells the few n of one node apart
    anything = F.array(F.struct(F.lit(0.0).alias("size"), F.lit(-1).cast("long").alias("p"), F.lit(0).cast("long").alias("q")))

    def removed_places(df: DataFrame) -> DataFrame:
        known = of.select(F.col("rn").alias("node"), "size", F.col("rn").alias("p"), "q").distinct().groupBy("node").agg(F.collect_list(F.struct("size", "p", "q")).alias("places"))  # a place per n
        found = df.join(known, "node", "left").select("id", F.coalesce("places", F.array().cast("array<struct<size:double,p:bigint,q:bigint>>")).alias("places"))
        return found.select("id", F.concat("places", anything).alias("places")) if all_qualify else found

    def added_places(df: DataFrame) -> DataFrame:
        found = df.join(of, df["node"] == of["an"]).select("id", F.col("rn").alias("p"), "q")
        return found.unionAll(df.select("id", F.lit(-1).cast("long"), F.lit(0).cast("long"))) if all_qualify else found

    return in_turns(rows[REMOVED], rows[ADDED], removed_places, added_places, at_once)


class Reconciled:
    """Changes, and what stays removed and added; rows are structs beside their ids."""

    def __init__(self, removed: DataFrame, added: DataFrame, columns: list[str], threshold: float = 0.5, semantics: str = "v2"):
        self.removed, self.added, self.columns = packed(removed, "ri", columns), packed(added, "ai", columns), columns
        self.matches = staged(match_rows(self.removed, self.added, columns, threshold, semantics))

    def changed(self) -> DataFrame:
        """(ri, ai, old, new)."""
        return self.matches.join(self.removed.withColumnRenamed("row", "old"), "ri").join(self.added.withColumnRenamed("row", "new"), "ai")

    def still_removed(self) -> DataFrame:
        return self.removed.join(self.matches.select("ri"), "ri", "left_anti")

    def still_added(self) -> DataFrame:
        return self.added.join(self.matches.select("ai"), "ai", "left_anti")
