"""Pairing two catalogues of file names by similarity, without listing all similar pairs.

OLD files, by rising id, each take the most similar free NEW file. That is the only assignment in which no
OLD file and a NEW file it likes better (one that is free, or taken by a later OLD file) are left over, so
it can be found from the heads of the files' lists. The first search lists only pairs of a high ratio; the
rule is applied to them; files that stay without a partner are searched for at the next lower ratio, and
so on to the threshold. A NEW file that an earlier OLD file holds is lost for good and isn't listed. The
result is final once every file has a partner or was searched for down to the threshold. Where ever more
files lose theirs again, all that are left are searched for at once.

A search is a grid: names of both sides are dealt to pieces, and a task meets two pieces. The characters
that two names match lie in order in both, in blocks. Their number is bounded by the bags of characters,
compared for all names of two pieces in a matrix product, and with it the number of pairs of neighbouring
characters they must share. What is left is compared by the ratio itself, many pairs at a time. Equal names
are one node, so a name that occurs often costs no more pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.matching import ratios
from ..functions.names import comparable_column
from .blocks import ADDED, REMOVED, Nodes, dealt_entries, linked, walk
from .heavy import heavy_hashes
from .reconcile import GIANT, assign
from .staging import staged

THRESHOLD = 0.85
#: Searches at falling ratios, and further ones at the threshold for files that lost their partner, before all that are left are searched for.
STEPS, AGAIN = 3, 1
#: Pairs of names up to which one search down to the threshold is less work than several.
FEW = 10_000_000
#: Names of a piece, at least and as a rule at most, and pieces that meet at most.
LEAST_PIECE, PIECE, MOST_CELLS = 1_024, 16_384, 10_000
#: Names and characters of a block of a piece, characters told apart there, and places for pairs of them.
BLOCK, BLOCK_CHARS, COMMON, GRAMS = 1_024, 1 << 21, 254, 512
_FREE = (1 << 63) - 1


class _Block:
    """Names of like length, as vectors."""

    def __init__(self, names: list[str], nodes: list[int], bounds: list[int], known: np.ndarray):
        self.names, self.nodes, self.bounds = names, np.array(nodes), np.array(bounds)
        self.len = np.array([len(n) for n in names])
        rows, tokens = bag(names)
        at = np.minimum(np.searchsorted(known, tokens), max(0, len(known) - 1))
        held = known[at] == tokens if len(known) else np.zeros(len(tokens), dtype=bool)
        self.bag = np.zeros((len(names), len(known)), dtype=np.float32)
        self.bag[rows[held], at[held]] = 1
        self.other = self.len - self.bag.sum(axis=1).astype(np.int64)
        codes = _codes(names).astype(np.uint64)
        of, i = np.nonzero(np.arange(codes.shape[1] - 1) < self.len[:, None] - 1)
        place = ((codes[of, i] * np.uint64(0x9E3779B97F4A7C15) + codes[of, i + 1]) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(55)
        self.grams = np.bincount(of * GRAMS + place.astype(np.int64), minlength=len(names) * GRAMS).reshape(-1, GRAMS).astype(np.int32)


def _codes(names: list[str]) -> np.ndarray:
    out = np.full((len(names), max(1, max(map(len, names)))), -1, dtype=np.int64)
    for k, n in enumerate(names):
        out[k, :len(n)] = np.frombuffer(n.encode("utf-32-le", "surrogatepass"), dtype=np.int32)
    return out


def bag(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(name, token) of all characters; a token is a character and how often it came before in the name."""
    codes = np.sort(_codes(names), axis=1)
    at = np.broadcast_to(np.arange(codes.shape[1]), codes.shape)
    first = np.ones_like(codes, dtype=bool)
    first[:, 1:] = codes[:, 1:] != codes[:, :-1]
    occurrence = at - np.maximum.accumulate(np.where(first, at, 0), axis=1)
    rows, cols = np.nonzero(codes >= 0)
    return rows, codes[rows, cols] << 32 | occurrence[rows, cols]


def _cuts(names: list[str]) -> list[slice]:
    """Blocks of names that come by rising length."""
    out, start = [], 0
    for k in range(1, len(names) + 1):
        if k == len(names) or k - start == BLOCK or (k + 1 - start) * len(names[k]) > BLOCK_CHARS:
            out.append(slice(start, k))
            start = k
    return out


def _blocks(piece: list[tuple[int, str, int]], cuts: list[slice], known: np.ndarray) -> list[_Block]:
    return [_Block([n for _, n, _ in piece[c]], [x for x, _, _ in piece[c]], [b for _, _, b in piece[c]], known) for c in cuts]


def _near(x: _Block, y: _Block, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs that the bounds let pass."""
    half = threshold / 2
    spare = np.minimum(x.other[:, None], y.other).astype(np.float32) if x.other.any() and y.other.any() else 0
    both = np.hstack([x.bag, (-half * x.len)[:, None], np.ones((len(x.len), 1))]).astype(np.float32) @ np.hstack([y.bag, np.ones((len(y.len), 1)), (-half * y.len)[:, None]]).astype(np.float32).T
    i, j = np.nonzero(both + spare >= -0.01 - 1e-5 * max(x.len[-1], y.len[-1]))
    free = y.bounds[j] > x.bounds[i]
    i, j = i[free], j[free]
    total = x.len[i] + y.len[j]
    # M matched characters leave T - 2M others, so they are in T - 2M + 1 blocks at most and share 3M - T - 1 pairs at least.
    need = 3 * np.ceil(half * total - 1e-9) - total - 1
    keep = np.zeros(len(i), dtype=bool)
    for k in range(0, len(i), 8_192):
        s = slice(k, k + 8_192)
        keep[s] = np.minimum(x.grams[i[s]], y.grams[j[s]]).sum(axis=1) >= need[s]
    return i[keep], j[keep]


def _meet_pieces(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(rn, an, n) from names (cell, side, node, name, bound) that come by cell."""
    def met(pieces: list[list[tuple[int, str, int]]]) -> Iterator[pa.RecordBatch]:
        if not all(pieces):
            return
        for p in pieces:
            p.sort(key=lambda x: len(x[1]))
        cuts = [_cuts([n for _, n, _ in p]) for p in pieces]
        seen: dict[int, int] = {}
        for p, cs in zip(pieces, cuts):
            for c in cs:
                for t, n in zip(*(v.tolist() for v in np.unique(bag([n for _, n, _ in p[c]])[1], return_counts=True))):
                    seen[t] = seen.get(t, 0) + n
        known = np.array(sorted(sorted(seen, key=lambda t: (-seen[t], t))[:COMMON]), dtype=np.int64)
        news = _blocks(pieces[1], cuts[1], known)
        for c in cuts[0]:
            x = _blocks(pieces[0], [c], known)[0]
            for y in news:
                if 2 * min(x.len[-1], y.len[-1]) < threshold * (min(x.len[-1], y.len[-1]) + max(x.len[0], y.len[0])) - 1e-9:
                    continue
                i, j = _near(x, y, threshold)
                for k in range(0, len(i), 65_536):
                    a, b = i[k:k + 65_536], j[k:k + 65_536]
                    n = ratios([x.names[v] for v in a], [y.names[v] for v in b], threshold)
                    good = n >= threshold
                    yield pa.RecordBatch.from_arrays([pa.array(x.nodes[a[good]], pa.int64()), pa.array(y.nodes[b[good]], pa.int64()), pa.array(n[good])], names=["rn", "an", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pieces = None, [[], []]
        for batch in batches:
            for cell, side, node, name, bound in zip(*(c.to_pylist() for c in batch.columns)):
                if cell != now:
                    yield from met(pieces)
                    now, pieces = cell, [[], []]
                pieces[side].append((node, name, bound))
        yield from met(pieces)

    return run


def similar_names(old: DataFrame, new: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(rn, an, n): distinct names (node, name, bound) of both sides with a ratio n of at least ``threshold``, where the new one's bound is greater."""
    counts = max(1, old.count()), max(1, new.count())
    across = math.sqrt(counts[0] * counts[1])
    size = max(min(PIECE, max(LEAST_PIECE, math.ceil(across / 6))), math.ceil(across / math.sqrt(MOST_CELLS)))
    n_old, n_new = (math.ceil(c / size) for c in counts)
    piece = lambda n: F.pmod(F.xxhash64("node"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")
    side = lambda df, mine, other, s, cell: df.select("node", "name", "bound", piece(mine).alias("p"), every(other)).select(cell.cast("int").alias("cell"), F.lit(s).alias("side"), "node", "name", "bound")
    both = side(old, n_old, n_new, 0, F.col("p") * n_new + F.col("k")).unionAll(side(new, n_new, n_old, 1, F.col("k") * n_new + F.col("p")))
    return both.repartitionById(n_old * n_new, F.col("cell")).sortWithinPartitions("cell").mapInArrow(_meet_pieces(threshold), "rn long, an long, n double")


def _taken(r: Nodes, a: Nodes, pairs: DataFrame, giant: int) -> DataFrame:
    """(ri, ai): the rule over the pairs of nodes alone."""
    dealt, large = dealt_entries(r, a, pairs, linked(pairs), giant=giant)
    done = dealt.mapInArrow(walk(None, False), "ri long, ai long")
    if large is not None:
        of = lambda kind, rid, node: large.where(F.col("kind") == kind).select(F.col("id").alias(rid), F.col("node").alias(node))
        rest = pairs.join(of(REMOVED, "ri", "rn"), "rn").join(of(ADDED, "ai", "an"), "an")
        done = done.unionByName(assign(rest.select("ri", "ai", F.col("n").alias("n_equal")), giant=giant))
    return staged(done)


def pair_catalogues(old: DataFrame, new: DataFrame, threshold: float = THRESHOLD, ignore_suffix: bool = False, giant: int = GIANT) -> DataFrame:
    """(old_id, new_id, ratio): each OLD file (id, name), by rising id, takes the most similar free NEW file, of equals the one of least id.

    Names are compared without extension and in lower case; a null name pairs with nothing. Ids are unique integers.
    """
    if not 0.5 <= threshold <= 1.0:
        raise ValueError("the threshold lies between 0.5 and 1")
    rows = [staged(s.where("name IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.array(comparable_column(F.col("name"), ignore_suffix)).alias("cells"))) for s in (old, new)]
    hot = heavy_hashes([s.select("cells") for s in rows], "cells")
    r, a = Nodes(rows[0], hot), Nodes(rows[1], hot)
    name = F.col("cells")[0].alias("name")
    # A node's bound is its least id: what that row can't have any more, none of the node's rows can.
    olds, news = r.nodes.select("node", name, F.col("node").alias("bound")), a.nodes.select("node", name, F.lit(_FREE).alias("bound"))
    steps = sorted({1 - (1 - threshold) * k / STEPS for k in range(1, STEPS)} | {threshold}, reverse=True)
    if olds.count() * news.count() <= FEW:
        steps = [threshold]
    whole = pairs = done = None  # whole: nodes searched for down to the threshold
    for k in range(len(steps) + AGAIN + 1):
        seek = olds
        if done is not None:
            if k < len(steps) + AGAIN:
                alone = r.rows.join(done.select(F.col("ri").alias("id")), "id", "left_anti").select("node").distinct()
                seek = seek.join(alone, "node", "left_semi")
            held = a.rows.join(done.select(F.col("ai").alias("id"), "ri"), "id", "left").groupBy("node").agg(F.max(F.coalesce("ri", F.lit(_FREE))).alias("bound"))
            news = a.nodes.select("node", name).join(held, "node")
        if whole is not None:
            seek = seek.join(whole, "node", "left_anti")
        seek = staged(seek)
        if seek.isEmpty():
            break
        at = steps[min(k, len(steps) - 1)]
        found = similar_names(seek, staged(news), at)
        pairs = staged(found if pairs is None else pairs.unionAll(found).distinct())
        done = _taken(r, a, pairs, giant)
        if at == threshold:
            whole = seek.select("node") if whole is None else staged(whole.unionAll(seek.select("node")))
    if done is None:
        return old.sparkSession.createDataFrame([], "old_id long, new_id long, ratio double")
    node = lambda s, rid, n: s.rows.select(F.col("id").alias(rid), F.col("node").alias(n))
    return done.join(node(r, "ri", "rn"), "ri").join(node(a, "ai", "an"), "ai").join(pairs, ["rn", "an"]).select(F.col("ri").alias("old_id"), F.col("ai").alias("new_id"), F.col("n").alias("ratio"))


def with_manual_pairs(auto: DataFrame, manual: DataFrame) -> DataFrame:
    """(old_id, new_id, ratio, origin): pairs (old_id, new_id) set by hand replace those found for the same OLD file."""
    found = auto.join(manual.select("old_id").distinct(), "old_id", "left_anti").select("old_id", "new_id", "ratio", F.lit("auto").alias("origin"))
    return found.unionByName(manual.select("old_id", "new_id", F.lit(1.0).alias("ratio"), F.lit("manual").alias("origin")))


def unpaired(old: DataFrame, new: DataFrame, pairs: DataFrame) -> DataFrame:
    """(side, id, name): files of either side that are in no pair."""
    left = lambda s, side: s.join(pairs.select(F.col(f"{side}_id").alias("id")).distinct(), "id", "left_anti").select(F.lit(side).alias("side"), "id", "name")
    return left(old, "old").unionByName(left(new, "new"))
