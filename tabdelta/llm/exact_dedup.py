"""Exact deduplication by Grace hashing.

Level 0 runs where the rows are: each task fills an open-addressing table that
compares complete texts, and flushes it when its window is full. A flush leaves
one representative per distinct text of the window, so a text that makes up a
third of all rows costs one representative per window and never meets in one
task as rows. The rows and their representatives are written to spill files in
the shared folder.

Between them a salted level takes the texts that still have more than HOT_REPS
representatives: each is dealt by its hash and a salt to as many tables as keep every
one to HOT_REPS, so no task reads a representative for each window there is.

Level 1 deals the representatives to buckets by a hash of the text and fills one
table per bucket. A bucket whose distinct texts exceed the table's bound is
written back, already merged, and dealt again by another hash at the next level,
until every bucket fits. Equality is decided by comparing whole texts; hashes
only choose slots and buckets.

Defined results: null texts count as empty. Of equal texts the row with the
largest id stays, a null id is the smallest, and among rows with equal id and
text the first read stays, so exactly one row per group is kept. Input columns
named like a result column are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .shared import Workspace, fresh, shuffle_partitions, without

#: Bytes of rows that a window of level 0 holds, and of distinct text that a bucket's table holds.
WINDOW_BYTES = 32 << 20
TABLE_BYTES = 48 << 20
#: Bytes of distinct text that a bucket is planned for.
BUCKET_BYTES = 12 << 20
MAX_LEVELS = 16
#: Representatives of one text that one task merges, and that one row of a finished group lists.
HOT_REPS = 1000

RESULT = ("keep_id", "group_size", "kept", "text_sha256")


class OpenTable:
    """Open addressing with linear probing; entries are equal only when their whole content is."""

    def __init__(self):
        self.slots, self.mask, self.content, self.hashes, self.bytes = [-1] * 1024, 1023, [], [], 0

    def find(self, content: bytes, h: int) -> tuple[int, bool]:
        """The entry of this content, and whether it is new."""
        i = h & self.mask
        while (e := self.slots[i]) >= 0:
            if self.hashes[e] == h and self.content[e] == content:
                return e, False
            i = (i + 1) & self.mask
        self.slots[i] = e = len(self.content)
        self.content.append(content)
        self.hashes.append(h)
        self.bytes += len(content) + 64
        if 3 * len(self.content) > 2 * self.mask:
            self.grow()
        return e, True

    def grow(self) -> None:
        self.mask = 2 * self.mask + 1
        self.slots = [-1] * (self.mask + 1)
        for e, h in enumerate(self.hashes):
            i = h & self.mask
            while self.slots[i] >= 0:
                i = (i + 1) & self.mask
            self.slots[i] = e


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _better(a, b) -> bool:
    """Whether (id, row) a is to stay rather than b."""
    if (a[0] is None) != (b[0] is None):
        return b[0] is None
    return a[1] < b[1] if a[0] == b[0] else a[0] > b[0]


def combine(docs: DataFrame, id_col: str, text_col: str, window_bytes: int = WINDOW_BYTES) -> tuple[DataFrame, dict[str, str]]:
    """Level 0: every row with its number and that of its representative; representatives carry the window's totals."""
    names = dict(zip(("row", "rep", "n", "sha", "hash", "bytes"), fresh([*docs.columns, *RESULT], "__row", "__rep", "__n", "__sha", "__hash", "__bytes")))
    L = T.LongType()
    schema = T.StructType(list(docs.schema) + [T.StructField(names["row"], L), T.StructField(names["rep"], L), T.StructField(names["n"], L), T.StructField(names["sha"], T.StringType()), T.StructField(names["hash"], L), T.StructField(names["bytes"], L)])
    low = [x.lower() for x in docs.columns]
    at_id, at_text = low.index(id_col.lower()), low.index(text_col.lower())

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        held, size = [], 0

        def flush():
            table, best, members, own = OpenTable(), [], [], []
            k = held[0][0]
            for _, b in held:
                ids = b.column(at_id).to_pylist()
                for x, t in zip(ids, b.column(at_text).cast(pa.large_binary())):
                    content = t.as_py() or b""
                    e, new = table.find(content, xxhash.xxh3_64_intdigest(content))
                    if new:
                        best.append((x, k))
                        members.append(0)
                    elif _better((x, k), best[e]):
                        best[e] = (x, k)
                    members[e] += 1
                    own.append(e)
                    k += 1
            at = 0
            for first, b in held:
                mine = own[at : at + b.num_rows]
                at += b.num_rows
                rows = range(first, first + b.num_rows)
                is_rep = [best[e][1] == r for e, r in zip(mine, rows)]
                pick = lambda f, kind: pa.array([f(e) if yes else None for e, yes in zip(mine, is_rep)], kind)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    b.columns + [pa.array(rows, pa.int64()), pa.array([best[e][1] for e in mine], pa.int64()), pick(lambda e: members[e], pa.int64()), pick(lambda e: hashlib.sha256(table.content[e]).hexdigest(), pa.string()), pick(lambda e: _signed(table.hashes[e]), pa.int64()), pick(lambda e: len(table.content[e]), pa.int64())],
                    names=list(b.schema.names) + list(names.values()),
                )

        for b in batches:
            if b.num_rows:
                held.append((row, b))
                row += b.num_rows
                size += b.nbytes
            if size >= window_bytes:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return docs.mapInArrow(run, schema), names


def resolve(reps: DataFrame, id_type: T.DataType, buckets: int, level: int, table_bytes: int, salts: Column | None = None) -> DataFrame:
    """One level: a table per bucket. Rows come out closed (a final group) or open (merged, for the next level).

    A closed group is a row per HOT_REPS of its representatives. With ``salts`` (a number per row) equal texts are
    dealt to several tables, so every row comes out open.
    """
    salted = salts is not None
    schema = T.StructType([T.StructField("reps", T.ArrayType(T.LongType())), T.StructField("best_id", id_type), T.StructField("best_row", T.LongType()), T.StructField("n", T.LongType()), T.StructField("sha", T.StringType()), T.StructField("hash", T.LongType()), T.StructField("text", T.StringType()), T.StructField("bytes", T.LongType())])

    def run(batches):
        arrow = [pa.list_(pa.int64()), None, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def entries(table, best, n, sha, reps, is_open, kind):
            step = 1 << 60 if is_open else HOT_REPS  # an open entry stays one row, for the next level counts it once
            parts = [(e, at) for e in range(len(n)) for at in range(0, len(reps[e]), step)]
            for lo in range(0, len(parts), 2000):
                own = parts[lo : lo + 2000]
                text = [table.content[e] if is_open else None for e, _ in own]
                cols = [[reps[e][at : at + step] for e, at in own], [best[e][0] for e, _ in own], [best[e][1] for e, _ in own], [n[e] for e, _ in own], [sha[e] for e, _ in own], [_signed(table.hashes[e]) for e, _ in own], pa.array(text, pa.binary()).cast(pa.string()), [len(table.content[e]) for e, _ in own]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t or kind) if not isinstance(c, pa.Array) else c for c, t in zip(cols, arrow)], names=[f.name for f in schema])

        table, best, n, sha, reps = OpenTable(), [], [], [], []
        overflowed, kind = salted, None
        for b in batches:
            kind = b.column(1).type
            cols = [b.column(k).to_pylist() for k in range(6)] + [b.column(6).cast(pa.large_binary())]
            for own, bid, brow, m, s, h, t in zip(*cols):
                content = t.as_py() or b""
                e, new = table.find(content, h & ((1 << 64) - 1))
                if new:
                    best.append((bid, brow))
                    n.append(m)
                    sha.append(s)
                    reps.append(own)
                else:
                    n[e] += m
                    reps[e] += own
                    if _better((bid, brow), best[e]):
                        best[e] = (bid, brow)
                if table.bytes > table_bytes and len(n) > 1:
                    overflowed = True
                    yield from entries(table, best, n, sha, reps, True, kind)
                    table, best, n, sha, reps = OpenTable(), [], [], [], []
        if n:
            yield from entries(table, best, n, sha, reps, overflowed, kind)

    deal = ["hash", salts] if salted else [F.xxhash64("hash", F.lit(level))]
    own = [f.name for f in schema][:7]
    return reps.repartition(buckets, *deal).select(own).mapInArrow(run, schema)


def merge_hot(left: DataFrame, id_type: T.DataType, work: Workspace, table_bytes: int) -> DataFrame:
    """Representatives with those of frequent texts merged by salt, again until no text has more than HOT_REPS."""
    for turn in range(MAX_LEVELS):
        hot = work.stage(left.groupBy("hash").agg(F.count(F.lit(1)).alias("m"), F.sum("bytes").alias("size")).where(F.col("m") > HOT_REPS), f"hot{turn}")
        total = hot.agg(F.sum("m").alias("m")).first().m
        if not total:
            return left
        rows = left.join(hot.select("hash", "m"), "hash")
        salt = F.pmod(F.xxhash64("best_row"), F.ceil(F.col("m") / HOT_REPS))
        parts = max(shuffle_partitions(left.sparkSession), -(-total // HOT_REPS))
        merged = work.stage(resolve(rows.withColumn("salt", salt), id_type, parts, 0, table_bytes, F.col("salt")), f"merged{turn}")
        left = left.join(hot.select("hash"), "hash", "left_anti").select(merged.columns).unionByName(merged)
    return left


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window_bytes: int = WINDOW_BYTES, table_bytes: int = TABLE_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs with keep_id, group_size, kept and text_sha256 (of the text in UTF-8) on every row."""
    spark = docs.sparkSession
    work = Workspace(spark, "exact_dedup")
    docs = without(docs, *[r for r in RESULT if r.lower() not in (id_col.lower(), text_col.lower())])
    level0, c = combine(docs, id_col, text_col, window_bytes)
    rows = work.stage(level0, "rows")
    left = rows.where(F.col(c["n"]).isNotNull()).select(
        F.array(c["rep"]).alias("reps"), F.col(f"`{id_col}`").alias("best_id"), F.col(c["row"]).alias("best_row"), F.col(c["n"]).alias("n"), F.col(c["sha"]).alias("sha"), F.col(c["hash"]).alias("hash"), F.col(f"`{text_col}`").alias("text"), F.col(c["bytes"]).alias("bytes"))
    id_type, closed, done = docs.select(F.col(f"`{id_col}`")).schema[0].dataType, None, False
    left = merge_hot(left, id_type, work, table_bytes)
    for level in range(1, MAX_LEVELS + 1):
        total = left.agg(F.sum("bytes")).first()[0] or 0
        buckets = max(shuffle_partitions(spark), -(-total // bucket_bytes)) * (1 if level == 1 else 2**level)
        out = work.stage(resolve(left, id_type, buckets, level, table_bytes), f"level{level}")
        fits = out.where(F.col("text").isNull())
        closed = fits if closed is None else closed.unionByName(fits)
        left = out.where(F.col("text").isNotNull())
        if done := left.isEmpty():
            break
    if not done:
        raise RuntimeError(f"buckets still exceed {table_bytes} bytes after {MAX_LEVELS} levels")
    (best,) = fresh([*docs.columns, *c.values(), *RESULT], "best")
    groups = closed.select(F.explode("reps").alias(c["rep"]), F.col("best_id").alias("keep_id"), F.col("best_row").alias(best), F.col("n").alias("group_size"), F.col("sha").alias("text_sha256"))
    joined = rows.drop(c["n"], c["sha"], c["hash"], c["bytes"]).join(groups, c["rep"])
    return joined.withColumn("kept", F.col(c["row"]) == F.col(best)).select(*[F.col(f"`{x}`") for x in docs.columns], *RESULT)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct text, with the columns of docs."""
    names = docs.columns
    plain = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in names if c.lower() != text_col.lower()]).alias("rest"))
    kept = exact_dedup(plain, "id", "text").where("kept")
    return kept.select([F.col("text").alias(c) if c.lower() == text_col.lower() else F.col(f"rest.`{c}`").alias(c) for c in names])
