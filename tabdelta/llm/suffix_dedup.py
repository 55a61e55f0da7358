"""Removal of repeated byte windows by a depth-limited most-significant-digit radix sort.

Two suffixes repeat a window exactly when they agree through ``threshold`` bytes, so
suffixes are grouped only that deep. Sorting all of them would shuffle many times
the input, so the sort is sparse: of the suffixes that start a window, only the
window's anchor is dealt out - the start, inside the window, of the ``digit``-byte
string with the least hash. Equal windows have their anchor at equal offsets, so
every repeat meets at its anchor, and the passes below decide it exactly:

1. first digit: anchors are grouped by the hash of their ``digit`` bytes; an anchor
   alone in its group repeats nothing and leaves;
2. full depth: those left are grouped by a 128-bit hash of all bytes that any window
   through the anchor can hold; groups of two or more are repeated as a whole;
3. further digits: where a first digit continues in several ways, the different
   contexts (one representative each) are split by the bytes that a half, a quarter,
   ... of the windows need, until groups agree on a window or stand alone. Small
   groups are sorted in one task, comparing bytes; larger ones are dealt out again
   by the next digit, so a passage that is frequent everywhere never meets in one
   task.

Counts are pre-aggregated before each shuffle; joins are against written tables,
so Spark can split their hot keys.

Defined results: a null text counts as empty; texts shorter than the threshold keep
everything; rows with equal id and text are different occurrences of the same bytes
and get equal results; columns named like a result column are replaced; an empty
table gives an empty result. Cutting bytes may split a character, so what is kept
is binary. Matches never cross documents. Texts are read in pieces of PIECE bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .shared import Workspace, fresh, probe, without

THRESHOLD = 400
DIGIT = 128
#: Contexts that one task sorts by itself; more are dealt out by their next digit.
GROUP_ROWS = 200
PIECE = 1 << 19
#: Bytes of text per batch that goes back.
FLUSH_BYTES = 4 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POS_BITS = np.uint64(20)
_POS_MASK = np.uint64((1 << 20) - 1)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Anchors:
    """Anchor positions of a text and the hash of the digit that starts at each."""

    def __init__(self, threshold: int, digit: int):
        if not 0 < digit < threshold:
            raise ValueError("the digit must be shorter than the threshold")
        self.t, self.k, self.w = threshold, digit, threshold - digit + 1
        n = PIECE + threshold + 1
        with np.errstate(over="ignore"):
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]), dtype=np.uint64)
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse)]), dtype=np.uint64)

    def of(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        at, hashes = [], []
        for lo in range(0, max(0, len(data) - self.t + 1), PIECE):
            p, h = self._piece(data[lo : lo + PIECE + self.t - 1])
            at.append(p + lo)
            hashes.append(h)
        if not at:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, first = np.unique(np.concatenate(at), return_index=True)
        return at, np.concatenate(hashes)[first].view(np.int64)

    def _piece(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        k, w = self.k, self.w
        raw = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
        n = len(raw) - k + 1
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(raw * self.up[: len(raw)], dtype=np.uint64)])
            h = (sums[k:] - sums[:n]) * self.down[:n]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
        v = (h & ~_POS_MASK) | np.arange(n, dtype=np.uint64)  # ties go to the left
        blocks = -(-n // w)
        padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
        padded[:n] = v
        grid = padded.reshape(blocks, w)
        before = np.minimum.accumulate(grid, axis=1).ravel()
        after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = n - w + 1
        least = np.minimum(after[:starts], before[w - 1 : w - 1 + starts])
        at = (least & _POS_MASK).astype(np.int64)
        at = at[np.flatnonzero(np.diff(at, prepend=-1))]
        return at, h[at]


def _halves(lo: int, hi: int):
    mid = (lo + hi) // 2
    return (lo, mid), (mid + 1, hi)


def needed(context: bytes, left: int, lo: int, hi: int, digit: int, room: int) -> bytes | None:
    """The bytes common to the windows that start lo..hi bytes before the anchor; None if the text ends before."""
    if left < lo or len(context) - left - digit < room - hi:
        return None
    return context[left - lo : left + digit + room - hi]


def agree(a: bytes, b: bytes) -> int:
    """The length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo = 0
    while n - lo > 1:
        mid = (lo + n) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            n = mid
    return lo


def sort_group(rows: list[tuple[bytes, int]], lo: int, hi: int, digit: int, room: int) -> list[tuple[int, int, int]]:
    """(row, first, last): windows starting first..last bytes before the anchor that another row repeats.

    Rows are held against one of them, on both sides of the digit at once. Two rows can
    agree on more than each agrees with that one only if they part from it at the same
    place with the same byte, so such rows are sorted further among themselves.
    """
    found: dict[int, list[tuple[int, int]]] = {}
    before = [c[:left][::-1][:room] for c, left in rows]
    after = [c[left + digit :][:room] for c, left in rows]
    sides = []
    if len(rows) > 3:
        for part in (before, after):
            flat = np.frombuffer(b"".join(x.ljust(room, b"\0") for x in part), np.uint8).reshape(len(rows), room)
            sides.append((flat, np.array([len(x) for x in part], np.int64)))

    def put(x: int, y: int, l: int, r: int) -> None:
        first, last = max(lo, room - r), min(hi, l)
        if first <= last:
            found.setdefault(x, []).append((first, last))
            found.setdefault(y, []).append((first, last))

    def part(own: np.ndarray, side: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """How long each row agrees with the first, and the rows that part from it alike."""
        flat, size = sides[side]
        differs = flat[own[1:]] != flat[own[0]]
        length = np.where(differs.any(1), differs.argmax(1), room)
        length = np.minimum(length, np.minimum(size[own[1:]], size[own[0]]))
        on = np.flatnonzero((length < room) & (length < size[own[1:]]))
        key = length[on] << 8 | flat[own[1:][on], length[on]]
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        return length, [own[1:][on[g]] for g in np.split(order, cuts) if len(g) > 1]

    groups: dict[bytes, list[int]] = {}
    for m, row in enumerate(rows):
        key = needed(*row, lo, hi, digit, room)
        if key is not None:
            groups.setdefault(key, []).append(m)
    stack = [np.array(g) for g in groups.values() if len(g) > 1]
    while stack:
        own = stack.pop()
        if len(own) <= 3:
            for i, x in enumerate(own.tolist()):
                for y in own[:i].tolist():
                    put(x, y, agree(before[x], before[y]), agree(after[x], after[y]))
            continue
        left, further = part(own, 0)
        right, more = part(own, 1)
        stack += further + more
        for k in np.flatnonzero(np.maximum(lo, room - right) <= np.minimum(hi, left)).tolist():
            put(int(own[k + 1]), int(own[0]), int(left[k]), int(right[k]))
    out = []
    for m, ranges in found.items():
        ranges.sort()
        first, last = ranges[0]
        for a, b in ranges[1:]:
            if a <= last + 1:
                last = max(last, b)
            else:
                out.append((m, first, last))
                first, last = a, b
        out.append((m, first, last))
    return out


def repeated_spans(docs: DataFrame, work: Workspace, threshold: int = THRESHOLD, digit: int = DIGIT, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(k1, k2, start, end): byte ranges of the texts that are covered by repeated windows; they may overlap.

    docs has the columns k1 and k2 (the key of a row) and text.
    """
    room = threshold - digit
    L, I, B = T.LongType(), T.IntegerType(), T.BinaryType()
    fields = lambda **k: T.StructType([T.StructField(n, t) for n, t in k.items()])

    def find(batches):
        anchors = Anchors(threshold, digit)
        for b in batches:
            k1, k2 = b.column(0).to_pylist(), b.column(1).to_pylist()
            cols = [[] for _ in range(8)]

            def out():
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0), t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["k1", "k2", "p", "first", "c1", "c2", "l", "r"])

            size = 0
            for a, z, t in zip(k1, k2, b.column(2).cast(pa.large_binary())):
                data = t.as_py() or b""
                at, h = anchors.of(data)
                if not len(at):
                    continue
                left, right = np.minimum(at, room), np.minimum(len(data) - at - digit, room)
                deep = [xxhash.xxh3_128_intdigest(data[p - x : p + digit + y], x) for p, x, y in zip(at.tolist(), left.tolist(), right.tolist())]
                values = (np.full(len(at), a), np.full(len(at), z), at, h, np.array([d >> 64 for d in deep], np.uint64).view(np.int64), np.array([d & 0xFFFFFFFFFFFFFFFF for d in deep], np.uint64).view(np.int64), left, right)
                for c, v in zip(cols, values):
                    c.append(v)
                size += len(at)
                if size > 100_000:
                    yield out()
                    cols, size = [[] for _ in range(8)], 0
            if size:
                yield out()

    anchors = work.stage(docs.select("k1", "k2", "text").mapInArrow(find, fields(k1=L, k2=I, p=I, first=L, c1=L, c2=L, l=I, r=I)), "anchors")
    # Pass 1: the first digit.
    shared = work.stage(anchors.groupBy("first").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("first"), "first_digit")
    left = work.stage(anchors.join(shared, "first", "left_semi"), "left")
    work.drop("anchors")
    # Pass 2: full depth.
    classes = work.stage(left.groupBy("first", "c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "p")).alias("x")), "classes")
    spans = left.join(classes.where("n > 1").select("first", "c1", "c2"), ["first", "c1", "c2"], "left_semi").where(f"l + r >= {room}").select("k1", "k2", (F.col("p") - F.col("l")).alias("start"), (F.col("p") + digit + F.col("r")).alias("end"))
    # Pass 3: further digits, for first digits that continue in several ways.
    several = work.stage(classes.groupBy("first").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("first"), "several")
    wanted = classes.join(several, "first", "left_semi").select("x.k1", "x.k2", F.struct("x.p", "first", (F.col("n") > 1).alias("done")).alias("a"))
    # A list holds the anchors of one text, at most one for each of its bytes.
    wanted = work.stage(wanted.groupBy("k1", "k2").agg(F.collect_list("a").alias("a")), "wanted")
    texts = probe(docs.select("k1", "k2", "text"), wanted, ["k1", "k2"])

    def contexts(batches):
        for b in batches:
            rows, size = [], 0
            for k1, k2, t, a in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.large_binary()), b.column(3)):
                data = t.as_py() or b""
                for x in a.as_py():
                    lo, hi = max(0, x["p"] - room), min(len(data), x["p"] + digit + room)
                    if hi - lo >= threshold:
                        rows.append((k1, k2, x["p"], x["first"], x["done"], x["p"] - lo, data[lo:hi], 0, room))
                        size += 1
                if size > 5000:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)

    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.int32(), pa.int32())
    named = dict(k1=L, k2=I, p=I, key=L, done=T.BooleanType(), l=I, context=B, lo=I, hi=I)
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=list(named))

    node, union = ["key", "lo", "hi"], ["u1", "u2"]
    split_named = dict(named, u1=L, u2=L)
    split_kinds = (*kinds, pa.int64(), pa.int64())

    def split(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                context, l = r["context"], r["l"]
                for lo, hi in _halves(r["lo"], r["hi"]):
                    own = needed(context, l, lo, hi, digit, room)
                    if own is None or max(lo, room - (len(context) - l - digit)) > min(hi, l):
                        continue
                    key = xxhash.xxh3_64_intdigest(own, lo)
                    u = xxhash.xxh3_128_intdigest(context[max(0, l - hi) : l + digit + room - lo], min(l, hi))
                    rows.append((r["k1"], r["k2"], r["p"], signed(key), r["done"], l, context, lo, hi, signed(u >> 64), signed(u & 0xFFFFFFFFFFFFFFFF)))
                if len(rows) > 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), split_kinds)], names=list(split_named))
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), split_kinds)], names=list(split_named))

    def sort(group: pa.Table) -> pa.Table:
        rows = list(zip(group["context"].to_pylist(), group["l"].to_pylist()))
        found = sort_group(rows, group["lo"][0].as_py(), group["hi"][0].as_py(), digit, room)
        done, k1, k2, p = (group[c].to_pylist() for c in ("done", "k1", "k2", "p"))
        keep = [(k1[m], k2[m], p[m] - last, p[m] - first + threshold) for m, first, last in found if not done[m]]
        return pa.Table.from_arrays([pa.array([x[k] for x in keep], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=["k1", "k2", "start", "end"])

    last = F.least("hi", "l")
    first = F.greatest(F.col("lo"), F.lit(room + digit) + F.col("l") - F.length("context"))
    reps = work.stage(texts.mapInArrow(contexts, fields(**named)), "reps0")
    for level in range(1, room.bit_length() + 2):
        nodes = work.stage(reps.groupBy(*node).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), f"nodes{level}")
        few = reps.join(nodes.where(F.col("n") <= group_rows).select(*node), node, "left_semi").select(*named)
        spans = spans.unionByName(work.stage(few.groupBy(*node).applyInArrow(sort, fields(k1=L, k2=I, start=I, end=I)), f"spans{level}"))
        hot = nodes.where(F.col("n") > group_rows).select(*node)
        if hot.isEmpty():
            break
        # The next digit of the large groups. Rows that agree on all their windows are done, and one of them stands for them below.
        own = work.stage(reps.join(hot, node, "left_semi").select(*named).mapInArrow(split, fields(**split_named)), f"rows{level}")
        alike = work.stage(own.groupBy(*node, *union).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "p", "l", "context", "done")).alias("x")), f"alike{level}")
        work.drop(f"reps{level - 1}")
        agreed = own.where("not done").join(alike.where("n > 1").select(*node, *union), [*node, *union], "left_semi")
        spans = spans.unionByName(work.stage(agreed.select("k1", "k2", (F.col("p") - last).alias("start"), (F.col("p") - first + threshold).alias("end")), f"agreed{level}"))
        work.drop(f"rows{level}")
        reps = work.stage(alike.select("x.k1", "x.k2", "x.p", "key", (F.col("x.done") | (F.col("n") > 1)).alias("done"), "x.l", "x.context", "lo", "hi"), f"reps{level}")
        work.drop(f"alike{level}")
    return spans


RESULT = ("n_bytes", "n_removed", "spans", "kept")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, digit: int = DIGIT, group_rows: int = GROUP_ROWS) -> DataFrame:
    """docs without the text, with n_bytes, n_removed, spans (maximal removed ranges of bytes) and kept (binary)."""
    work = Workspace(docs.sparkSession, "suffix_dedup")
    rest = without(docs, *RESULT, text_col).columns
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    keys = fresh(rest, "k1", "k2", "text", "found")
    c1, c2, ct, cf = keys
    keyed = docs.select(*[F.col(f"`{c}`") for c in rest], F.xxhash64(F.col(f"`{id_col}`"), text).alias(c1), F.hash(text).alias(c2), text.alias(ct))
    spans = repeated_spans(keyed.select(F.col(c1).alias("k1"), F.col(c2).alias("k2"), F.col(ct).alias("text")), work, threshold, digit, group_rows)
    per_doc = work.stage(spans.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias(cf)), "spans").select(F.col("k1").alias(c1), F.col("k2").alias(c2), cf)
    joined = probe(keyed, per_doc, [c1, c2], "left").select(ct, cf, *[F.col(f"`{c}`") for c in rest])
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*joined.select([F.col(f"`{c}`") for c in rest]).schema, T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", span), T.StructField("kept", T.BinaryType())])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches):
        for b in batches:
            lengths, removed, runs, kept, start, size = [], [], [], [], 0, 0
            for k, (t, f) in enumerate(zip(b.column(0).cast(pa.large_binary()), b.column(1))):
                data, merged = t.as_py() or b"", []
                for x in f.as_py() or ():
                    if merged and x["start"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x["end"])
                    else:
                        merged.append([x["start"], x["end"]])
                at, parts = 0, []
                for lo, hi in merged:
                    parts.append(data[at:lo])
                    at = hi
                parts.append(data[at:])
                lengths.append(len(data))
                removed.append(sum(hi - lo for lo, hi in merged))
                runs.append([{"start": lo, "end": hi} for lo, hi in merged])
                kept.append(b"".join(parts))
                size += len(data)
                if size > FLUSH_BYTES or k + 1 == b.num_rows:
                    yield pa.RecordBatch.from_arrays([*b.slice(start, k + 1 - start).columns[2:], pa.array(lengths, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary())], names=[f.name for f in schema])
                    lengths, removed, runs, kept, start, size = [], [], [], [], k + 1, 0

    return joined.mapInArrow(cut, schema)
