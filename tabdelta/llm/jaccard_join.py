"""Exact Jaccard join of documents on word shingles, as a metric-space join.

Jaccard distance is a metric, so a pivot's distances bound all others. Documents
with equal sets are one point. The join has two kinds of pivots:

* Outer cells. The pivots are single shingles, ordered from rare to frequent by a
  fixed-size sketch of counts over all documents. A point belongs to the cell of its
  first shingle, and it is replicated to the cells of further shingles as long as a
  partner within the radius could meet it there: a partner's distance bounds how many
  of a point's first shingles it can lack, so the window is (1 - t)|A| + 1 shingles
  wide, and positions and sizes narrow it for each pair. Every linked pair shares
  the cell of its first common shingle.
* Inner pivots. Each cell takes its most central point as pivot and compares it with
  all others. Points within the radius are linked and need no comparison among
  themselves. Points outside it are compared with the cell's other points whose
  distance to the pivot differs by at most the radius (the triangle inequality);
  where that is still much work, the cell takes a further pivot from them and the
  step recurs. Comparisons are exact, on whole sets.

A cell whose pivot may be frequent is dealt out by salt, and its parts then share one
pivot, so no task sees more than its share; cells are streamed, never gathered.

Defined results: a null text or one without words has an empty set and is linked with
nothing, equal rows included. Texts of fewer words than a shingle have their whole
word sequence as one shingle. Every row gives one row; rows with equal sets share a
component. The component's id is the least id in it (null is the least). Columns
named like a result column are replaced. An empty table gives an empty result.
Shingles are compared by 64-bit hashes and equal sets found by 128-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .components import components, spread
from .shared import Workspace, fresh, probe, shuffle_partitions, without

WORDS = 5
#: Similarity of at least NUM/DEN links two documents.
NUM, DEN = 4, 5
SKETCH_BITS = 20
SKETCH_CHUNK = 1 << 14
#: Rows of one cell that one task streams; cells that may have more are salted.
CELL_ROWS = 50_000
#: Cells of up to so many points drop points without a possible partner at once.
SMALL_CELL = 32
#: Comparisons a cell may still need after its pivot before it takes another.
CELL_PAIRS = 100_000
#: Pairs of a cell that are held against the bounds for each that may be compared.
LOOKS = 500
MAX_PIVOTS = 12

_CACHE_WORDS = 2_000_000
_ODD = [np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1) ^ (0xC2B2AE3D27D4EB4F >> k)) & 0xFFFFFFFFFFFFFFFF | 1) for k in range(64)]


class Shingles:
    """The sorted distinct shingle hashes of a text in UTF-8."""

    def __init__(self, words: int = WORDS):
        self.words, self.known = words, {}

    def of(self, data: bytes) -> np.ndarray:
        words = data.lower().split()  # bytes: A-Z only, and exactly the six ASCII blanks
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < self.words:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
        known = self.known
        if len(known) > _CACHE_WORDS:
            known.clear()
        numbers = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            numbers.append(h)
        a = np.array(numbers, np.uint64)
        n = len(a) - self.words + 1
        with np.errstate(over="ignore"):
            h = a[:n] * _ODD[0]
            for k in range(1, self.words):
                h += a[k : n + k] * _ODD[k % 64]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
        return np.unique(h)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def set_key(own: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(own.tobytes())
    return signed(d >> 64), signed(d & 0xFFFFFFFFFFFFFFFF)


def prefix_length(n: int) -> int:
    """How many first shingles of a set of n a linked set can't all lack."""
    return n - -(-NUM * n // DEN) + 1


def may_link(n, i, m, j):
    """Whether sets of n and m elements whose first common element has positions i and j (from 1) can be similar enough."""
    smaller, larger = np.minimum(n, m), np.maximum(n, m)
    return (DEN * smaller >= NUM * larger) & ((NUM + DEN) * (np.minimum(n - i, m - j) + 1) >= NUM * (n + m))


def may_link_column(n: Column, i: Column, m: Column, j: Column) -> Column:
    return (DEN * F.least(n, m) >= NUM * F.greatest(n, m)) & ((NUM + DEN) * (F.least(n - i, m - j) + 1) >= NUM * (n + m))


class JaccardJoin:
    """The join of one table; the steps are methods so that tests can look at each."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, words: int, cell_rows: int, small_cell: int, cell_pairs: int, sketch_bits: int):
        self.spark, self.words = docs.sparkSession, words
        self.cell_rows, self.small_cell, self.cell_pairs, self.sketch_bits = cell_rows, small_cell, cell_pairs, sketch_bits
        self.work = Workspace(self.spark, "jaccard_join")
        self.rest = without(docs, "n_shingles", "component_id", text_col).columns
        self.id_col = id_col
        text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
        key = F.to_json(F.struct(F.col(f"`{id_col}`"))) if isinstance(docs.schema[id_col].dataType, (T.StructType, T.ArrayType, T.MapType)) else F.col(f"`{id_col}`")
        self.k1, self.k2, self.text, self.n, self.c1, self.c2, self.chunk, self.counts = fresh(self.rest, "k1", "k2", "text", "n", "c1", "c2", "chunk", "counts")
        self.docs = docs.select(text.alias(self.text), F.xxhash64(key, text).alias(self.k1), F.hash(text).alias(self.k2), *[F.col(f"`{c}`") for c in self.rest])

    # -- points and counts -------------------------------------------------------------------------------------
    def scan(self) -> None:
        """One pass over the texts: a row per document with the key of its set, and rows of the sketch."""
        words, bits, chunk = self.words, self.sketch_bits, min(SKETCH_CHUNK, 1 << self.sketch_bits)
        L = T.LongType()
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in list(self.docs.schema)[1:]] + [T.StructField(self.n, L), T.StructField(self.c1, L), T.StructField(self.c2, L), T.StructField(self.chunk, T.IntegerType()), T.StructField(self.counts, T.BinaryType())])

        def run(batches):
            shingles, counts, like = Shingles(words), np.zeros(1 << bits, np.int64), None
            mask = np.uint64((1 << bits) - 1)
            for b in batches:
                like = b
                n, keys, own = [], [], []
                for t in b.column(0).cast(pa.large_binary()):
                    x = shingles.of(t.as_py())
                    n.append(len(x))
                    keys.append(set_key(x))
                    own.append(x & mask)
                    if len(own) >= 500:
                        counts += np.bincount(np.concatenate(own).astype(np.int64), minlength=1 << bits)
                        own = []
                if own:
                    counts += np.bincount(np.concatenate(own).astype(np.int64), minlength=1 << bits)
                rows = b.num_rows
                yield pa.RecordBatch.from_arrays(b.columns[1:] + [pa.array(n, pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names=[f.name for f in schema])
            if like is not None and counts.any():
                parts = np.minimum(counts, np.iinfo(np.int32).max).astype("<i4").reshape(-1, chunk)
                rows = len(parts)
                yield pa.RecordBatch.from_arrays([pa.nulls(rows, c.type) for c in like.columns[1:]] + [pa.nulls(rows, pa.int64())] * 3 + [pa.array(range(rows), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=[f.name for f in schema])

        found = self.work.stage(self.docs.mapInArrow(run, schema), "scan")
        self.rows = found.where(F.col(self.chunk).isNull()).drop(self.chunk, self.counts)
        self.sketch = self.sum_sketch(found.where(F.col(self.chunk).isNotNull()).select(F.col(self.chunk).alias("chunk"), F.col(self.counts).alias("counts")))
        some = self.rows.where(F.col(self.n) > 0)
        # Points are numbered once, as they are written, so that all later steps group and join by one long. k1 and k2
        # name one of the point's documents: the two first() see the same rows, and neither is ever null.
        points = some.groupBy(F.col(self.c1).alias("a"), F.col(self.c2).alias("b")).agg(
            F.min(F.col(f"`{self.id_col}`")).alias("least_id"), F.first(self.k1).alias("k1"), F.first(self.k2).alias("k2"), F.max(F.when(F.col(f"`{self.id_col}`").isNull(), 1).otherwise(0)).alias("no_id"), F.max(self.n).alias("n"))
        self.points = self.work.stage(points.withColumn("node", F.monotonically_increasing_id()), "points")

    def sum_sketch(self, rows: DataFrame) -> np.ndarray:
        """The sketch of all tasks: summed within the tasks that read it, then by chunk, streaming; 4 bytes a slot reach the driver."""
        size = min(SKETCH_CHUNK, 1 << self.sketch_bits)

        def run(batches):
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    sums[k] = sums.get(k, 0) + np.frombuffer(c, "<i4").astype(np.int64)
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.minimum(v, np.iinfo(np.int32).max).astype("<i4").tobytes() for v in sums.values()], pa.binary())], names=["chunk", "counts"])

        schema = "chunk int, counts binary"
        chunks = (1 << self.sketch_bits) // size
        total = np.zeros(1 << self.sketch_bits, np.int32)
        for r in rows.mapInArrow(run, schema).repartition(chunks, "chunk").mapInArrow(run, schema).toLocalIterator():
            total[r.chunk * size : (r.chunk + 1) * size] = np.frombuffer(r.counts, "<i4")
        return total

    # -- cells --------------------------------------------------------------------------------------------------
    def cells(self) -> None:
        """(s, member, pivot) rows of every cell with two points that might be linked."""
        words, bits, cell_rows, small_cell = self.words, self.sketch_bits, self.cell_rows, self.small_cell
        sketch = self.spark.sparkContext.broadcast(self.sketch)  # 4 bytes times 2^SKETCH_BITS, whatever the input
        L, I = T.LongType(), T.IntegerType()
        fields = [("s", L), ("salt", I), ("c1", L), ("c2", L), ("n", I), ("pos", I), ("pr", T.DoubleType())]
        schema = T.StructType([T.StructField(a, t) for a, t in fields])
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
        mask = np.uint64((1 << bits) - 1)

        def prefixes(batches):
            shingles, counts, seen = Shingles(words), sketch.value, set()
            for b in batches:
                cols, size = [[] for _ in fields], 0
                for t in b.column(0).cast(pa.large_binary()):
                    own = shingles.of(t.as_py())
                    if not len(own) or (key := set_key(own)) in seen:
                        continue
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(key)
                    freq = counts[(own & mask).astype(np.int64)]
                    k = prefix_length(len(own))
                    first = np.lexsort((own, freq))[:k]
                    at, often = own[first], freq[first].astype(np.int64)
                    salt = (np.uint64(key[0] & 0xFFFFFFFF) % (often // cell_rows + 1).astype(np.uint64)).astype(np.int32)
                    salt[often < cell_rows] = -1
                    for c, v in zip(cols, (at.view(np.int64), salt, np.full(k, key[0]), np.full(k, key[1]), np.full(k, len(own), np.int32), np.arange(1, k + 1, dtype=np.int32), np.full(k, float(freq.mean())))):
                        c.append(v)
                    size += k
                    if size > 200_000:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(cols, types)], names=[a for a, _ in fields])
                        cols, size = [[] for _ in fields], 0
                if size:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(cols, types)], names=[a for a, _ in fields])

        out_fields = [("s", L), ("salted", T.BooleanType()), ("c1", L), ("c2", L), ("n", I), ("pos", I), ("pr", T.DoubleType()), ("p1", L), ("p2", L), ("pn", I), ("ppos", I), ("ppr", T.DoubleType())]
        out_schema = T.StructType([T.StructField(a, t) for a, t in out_fields])
        out_types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]

        def group(batches):
            """Sorted rows to cells; a cell longer than a batch is passed on in parts that keep its pivot."""
            carry, pivot = None, None  # rows of the unfinished cell; its pivot once a part was passed on

            def out(rows, member, head):
                return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([rows[0][member], rows[1][member] >= 0, *[c[member] for c in rows[2:]], *[c[head] for c in rows[2:]]], out_types)], names=[a for a, _ in out_fields])

            def whole(rows, starts, lengths):
                """Members and heads of complete cells."""
                members, heads = [], []
                salted = rows[1][starts] >= 0
                two = (lengths == 2) & ~salted
                a, b = starts[two], starts[two] + 1
                fine = ((rows[2][a] != rows[2][b]) | (rows[3][a] != rows[3][b])) & may_link(rows[4][a].astype(np.int64), rows[5][a], rows[4][b].astype(np.int64), rows[5][b])
                a, b = a[fine], b[fine]
                members += [a, b]
                heads += [a, a]
                for lo, n, salty in zip(starts[(lengths > 2) | salted].tolist(), lengths[(lengths > 2) | salted].tolist(), salted[(lengths > 2) | salted].tolist()):
                    at = np.arange(lo, lo + n)
                    new = np.ones(n, bool)
                    new[1:] = (rows[2][at[1:]] != rows[2][at[:-1]]) | (rows[3][at[1:]] != rows[3][at[:-1]])
                    at = at[new]
                    if not salty:
                        if len(at) <= small_cell:
                            size, pos = rows[4][at].astype(np.int64), rows[5][at]
                            fine = may_link(size[:, None], pos[:, None], size[None, :], pos[None, :])
                            np.fill_diagonal(fine, False)
                            at = at[fine.any(1)]
                        if len(at) < 2:
                            continue
                    members.append(at)
                    heads.append(np.full(len(at), at[0]))
                return np.concatenate(members), np.concatenate(heads)

            for b in batches:
                rows = [c.to_numpy(zero_copy_only=False) for c in b.columns]
                if not len(rows[0]):
                    continue
                if carry is not None:
                    rows = [np.concatenate([x, y]) for x, y in zip(carry, rows)]
                edge = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])) + 1
                starts = np.concatenate([[0], edge])
                if pivot is not None:  # rows 0 and on carry on a cell that was passed on in part; row 0 is its pivot
                    end = int(edge[0]) if len(edge) else len(rows[0])
                    if end > 1:
                        yield out(rows, np.arange(1, end), np.zeros(end - 1, np.int64))
                    if not len(edge):
                        carry = [c[:1] for c in rows]
                        continue
                    starts, pivot = starts[1:], None
                last = int(starts[-1])
                if len(starts) > 1:
                    member, head = whole(rows, starts[:-1], np.diff(starts))
                    if len(member):
                        yield out(rows, member, head)
                carry = [c[last:] for c in rows]
                if len(carry[0]) > 20_000:
                    new = np.ones(len(carry[0]), bool)
                    new[1:] = (carry[2][1:] != carry[2][:-1]) | (carry[3][1:] != carry[3][:-1])
                    at = np.flatnonzero(new)
                    yield out(carry, at, np.zeros(len(at), np.int64))
                    carry, pivot = [c[:1] for c in carry], True
            if carry is not None and pivot is None:
                member, head = whole(carry, np.array([0]), np.array([len(carry[0])]))
                if len(member):
                    yield out(carry, member, head)

        total = self.points.agg(F.sum("n")).first()[0] or 0
        parts = max(shuffle_partitions(self.spark), -(-total // (5 * 1_000_000)))
        rows = self.docs.select(self.text).mapInArrow(prefixes, schema).repartition(parts, "s", "salt").sortWithinPartitions("s", "salt", F.desc("pr"), "c1", "c2").mapInArrow(group, out_schema)
        found = self.work.stage(rows.select("s", "salted", "c1", "c2", "n", "pos", "pr", F.struct("ppr", "p1", "p2", "pn", "ppos").alias("head")), "parts")
        plain = found
        if not found.where("salted").isEmpty():
            tops = self.work.stage(found.where("salted").groupBy("s").agg(F.max("head").alias("top")), "tops")
            one = found.where("salted").join(tops, "s").withColumn("head", F.col("top")).drop("top")
            plain = self.work.stage(found.where("not salted").unionByName(one), "cells")
        number = lambda a, b, name: self.points.select(F.col("a").alias(a), F.col("b").alias(b), F.col("node").alias(name))
        plain = plain.select("s", "c1", "c2", "n", "pos", "pr", F.col("head.p1").alias("p1"), F.col("head.p2").alias("p2"), F.col("head.pn").alias("pn"), F.col("head.ppos").alias("ppos"))
        numbered = plain.join(number("c1", "c2", "x"), ["c1", "c2"]).drop("c1", "c2").join(number("p1", "p2", "p"), ["p1", "p2"])
        self.members = self.work.stage(numbered.select("s", "x", "n", "pos", "pr", "p", "pn", "ppos"), "members")
        for name in ("parts", "tops", "cells"):
            self.work.drop(name)

    # -- comparisons --------------------------------------------------------------------------------------------
    def fetch_sets(self) -> None:
        """The sets of all points in cells, each from one of its documents."""
        words = self.words
        wanted = self.members.select(F.col("x").alias("node")).distinct().join(self.points, "node").select("node", F.col("k1").alias(self.k1), F.col("k2").alias(self.k2))
        wanted = self.work.stage(wanted, "wanted")
        texts = probe(self.docs.select(self.k1, self.k2, self.text), wanted, [self.k1, self.k2]).select("node", self.text)

        def run(batches):
            shingles = Shingles(words)
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles.of(t.as_py()).tobytes() for t in b.column(1).cast(pa.large_binary())], pa.binary())], names=["node", "elements"])

        self.sets = self.work.stage(texts.mapInArrow(run, T.StructType([wanted.schema["node"], T.StructField("elements", T.BinaryType())])), "sets")

    def compare(self, pairs: DataFrame, name: str) -> DataFrame:
        """(u, v, distance, linked) for distinct pairs of points u < v."""
        pairs = self.work.stage(pairs, f"{name}-pairs")
        with_u = pairs.join(self.sets.withColumnRenamed("node", "u").withColumnRenamed("elements", "eu"), "u")
        both = with_u.join(self.sets.withColumnRenamed("node", "v").withColumnRenamed("elements", "ev"), "v").select("u", "v", "eu", "ev")

        def run(batches):
            for b in batches:
                distance, linked = [], []
                for x, y in zip(b.column(2), b.column(3)):
                    x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    either = len(x) + len(y) - both
                    distance.append(1 - both / either)
                    linked.append(DEN * both >= NUM * either)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(distance, pa.float64()), pa.array(linked, pa.bool_())], names=["u", "v", "distance", "linked"])

        return self.work.stage(both.mapInArrow(run, T.StructType([*pairs.schema, T.StructField("distance", T.DoubleType()), T.StructField("linked", T.BooleanType())])), name)

    @staticmethod
    def pair(x: str, y: str) -> list[Column]:
        return [F.least(x, y).alias("u"), F.greatest(x, y).alias("v")]

    def labelled(self, labels: DataFrame, distances: DataFrame) -> DataFrame:
        """Members with their and their pivot's component so far, and their distance to the pivot where it was taken."""
        m = self.members.join(labels.select(F.col("node").alias("x"), F.col("label").alias("lx")), "x", "left").join(labels.select(F.col("node").alias("p"), F.col("label").alias("lp")), "p", "left")
        d = distances.select("u", "v", "distance")
        m = m.select("s", "x", "n", "pos", "pr", "p", F.coalesce("lx", "x").alias("lx"), F.coalesce("lp", "p").alias("lp"), *self.pair("x", "p"))
        return m.join(d, ["u", "v"], "left").drop("u", "v")

    def links(self) -> DataFrame:
        """Links (u, v) between points that connect whatever is connected."""
        star = self.members.where("x != p").where(may_link_column(F.col("n"), F.col("pos"), F.col("pn"), F.col("ppos"))).select(*self.pair("x", "p")).distinct()
        tested = self.compare(star, "star")
        used = None  # (cell, point) that was compared with all of its cell
        for turn in range(MAX_PIVOTS + 1):  # a turn per further pivot; most inputs need none
            labels = self.work.stage(spread(tested.where("linked")), f"near{turn}")
            rows = self.work.stage(self.labelled(labels, tested), f"labelled{turn}")
            outside = rows.where("lx != lp")
            if used is not None:
                outside = outside.join(used, ["s", "x"], "left_anti")
            if turn == MAX_PIVOTS:
                break
            # Cells that still have much to compare, or too many points even to count that, take a further pivot.
            looked = outside.groupBy("s").agg(F.count(F.lit(1)).alias("n_out")).join(rows.groupBy("s").agg(F.count(F.lit(1)).alias("n_all")), "s")
            looked = self.work.stage(looked.select("s", (F.col("n_out") * F.col("n_all")).alias("looks")), f"looks{turn}")
            few = outside.join(looked.where(F.col("looks") <= self.cell_pairs * LOOKS).select("s"), "s", "left_semi")
            much = self.open_pairs(few, rows).groupBy("s").agg(F.count(F.lit(1)).alias("looks")).where(F.col("looks") > self.cell_pairs)
            big = self.work.stage(looked.where(F.col("looks") > self.cell_pairs * LOOKS).select("s").unionByName(much.select("s")), f"big{turn}")
            if big.isEmpty():
                break
            heads = outside.join(big, "s").groupBy("s").agg(F.max(F.struct("pr", "x", "n", "pos", "lx", "distance")).alias("h"))
            heads = self.work.stage(heads.select("s", F.col("h.x").alias("x"), F.col("h.n").alias("n"), F.col("h.pos").alias("pos"), F.col("h.lx").alias("lx"), F.col("h.distance").alias("distance")), f"heads{turn}")
            tested = tested.unionByName(self.compare(self.untested(self.open_pairs(heads, rows), tested), f"turn{turn}"))
            used = heads.select("s", "x") if used is None else used.unionByName(heads.select("s", "x"))
        return tested.unionByName(self.compare(self.untested(self.open_pairs(outside, rows), tested), "rest")).where("linked").select("u", "v")

    def open_pairs(self, some: DataFrame, rows: DataFrame) -> DataFrame:
        """(s, u, v): pairs of ``some`` points with others of their cells, of other components, that no bound rules out."""
        a = some.select("s", F.col("x").alias("xa"), F.col("n").alias("na"), F.col("pos").alias("ia"), F.col("lx").alias("la"), F.col("distance").alias("da"))
        b = rows.select("s", F.col("x").alias("xb"), F.col("n").alias("nb"), F.col("pos").alias("ib"), F.col("lx").alias("lb"), F.col("distance").alias("db"))
        window = F.coalesce(F.abs(F.col("da") - F.col("db")) <= 1 - NUM / DEN + 1e-9, F.lit(True))
        fits = (F.col("la") != F.col("lb")) & window & may_link_column(F.col("na"), F.col("ia"), F.col("nb"), F.col("ib"))
        return a.join(b, (a["s"] == b["s"]) & fits).select(a["s"], *self.pair("xa", "xb"))

    @staticmethod
    def untested(pairs: DataFrame, tested: DataFrame) -> DataFrame:
        return pairs.select("u", "v").distinct().join(tested.select("u", "v"), ["u", "v"], "left_anti")

    # -- result -------------------------------------------------------------------------------------------------
    def run(self) -> DataFrame:
        self.scan()
        self.cells()
        self.work.tidy()
        self.fetch_sets()
        self.work.tidy()
        labels = self.work.stage(components(self.links(), self.work, "final"), "labels")
        joined = labels.join(self.points, "node").select("node", "label", "least_id", "no_id")
        least = joined.groupBy("label").agg(F.min("least_id").alias("least"), F.max("no_id").alias("none"))
        named = self.points.join(labels.join(least, "label").select("node", "least", "none"), "node", "left")
        component = F.when(F.coalesce("none", "no_id") == 0, F.coalesce("least", "least_id"))
        ids = self.work.stage(named.select(F.col("a").alias(self.c1), F.col("b").alias(self.c2), component.alias("component_id")), "ids")
        own = [F.col(f"`{c}`") for c in self.rest]
        linked = self.rows.where(F.col(self.n) > 0).join(ids, [self.c1, self.c2]).select(*own, F.col(self.n).alias("n_shingles"), "component_id")
        empty = self.rows.where(F.col(self.n) == 0).select(*own, F.col(self.n).alias("n_shingles"), F.col(f"`{self.id_col}`").alias("component_id"))
        return linked.unionByName(empty)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, cell_rows: int = CELL_ROWS, small_cell: int = SMALL_CELL, cell_pairs: int = CELL_PAIRS, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """docs without the text, with n_shingles and component_id."""
    return JaccardJoin(docs, id_col, text_col, words, cell_rows, small_cell, cell_pairs, sketch_bits).run()


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every component, the one with the least id, with the columns of docs.

    Rows without words stay. Rows with equal id and text are one document: one of them stays.
    """
    work = Workspace(docs.sparkSession, "one_of_each")
    key = kid, h1, h2 = fresh([*docs.columns, "id"], "kid", "h1", "h2")
    (whole,) = fresh([*docs.columns, *key], "whole")
    text, own_id = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    named = lambda i, none: F.to_json(F.struct(i.alias("id"), none.alias("none")))
    keyed = docs.withColumns({kid: named(own_id, text.isNull()), h1: F.xxhash64(text), h2: F.hash(text)})
    join = JaccardJoin(keyed.select(F.struct(own_id.alias("id"), text.isNull().alias("none"), h1, h2).alias(whole), text.alias("text")), whole, "text", WORDS, CELL_ROWS, SMALL_CELL, CELL_PAIRS, SKETCH_BITS)
    least = join.run().where(F.col(whole) == F.col("component_id"))
    stay = work.stage(least.select(named(F.col(f"{whole}.id"), F.col(f"{whole}.none")).alias(kid), F.col(f"{whole}.{h1}").alias(h1), F.col(f"{whole}.{h2}").alias(h2)).distinct(), "stay")
    join.work.drop()
    work.tidy()
    kept = probe(keyed, stay, key, "left_semi")
    if not keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        kept = kept.dropDuplicates(key)
    return kept.select([F.col(f"`{c}`") for c in docs.columns])
