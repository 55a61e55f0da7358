"""Hierarchical multi-length packing.

Each document is encoded and ended by an end token. Full windows of the longest
tier are cut off first; the remainder is routed to the shortest tier (128, 256,
512 or 1024 tokens by default) that holds it. Tiers are packed from long to
short: a remainder opens a window of its tier, and the gap is filled with whole
remainders of shorter tiers, longest first, and at last with the head of one
more, so that a window is closed only when it is full. What can't be filled in
a block is carried into the next; at the end of a task the rest is cut into
windows of tier lengths and then powers of two, so that no position is padded.
Sequences of a block are dealt to step groups of equal token budgets in
serpentine order of their attention cost.

Packing needs no shuffle: every task packs the rows it reads, holding one block
of documents. Ids of sequences and step groups carry the task's number.

Defined results: a null text counts as empty and yields its end token alone; rows
are packed one by one, so repeated rows and null or equal ids are kept; extra
columns are ignored; an id column named like a column of the pieces comes back with
an underscore before its name; an empty table gives no pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from .bpe import default_path, json_bpe
from .shared import fresh

TIERS = (128, 256, 512, 1024)
END_TOKEN = 0
STEP_TOKENS = 8192
BLOCK_TOKENS = 1_500_000

PIECES = T.StructType([
    T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("doc_tokens", T.LongType()),
    T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("sequence_tokens", T.LongType()),
    T.StructField("tier", T.IntegerType()), T.StructField("step_group", T.LongType()), T.StructField("token_bytes", T.BinaryType()),
])


class Pool:
    """Remainders by length; the longest that fits, or any longer one, is found by bit arithmetic."""

    def __init__(self):
        self.by_length: dict[int, list] = {}
        self.bits = 0

    def add(self, length: int, piece) -> None:
        self.by_length.setdefault(length, []).append(piece)
        self.bits |= 1 << length

    def take(self, length: int):
        own = self.by_length[length]
        piece = own.pop()
        if not own:
            self.bits &= ~(1 << length)
        return piece

    def longest(self, most: int) -> int:
        """The greatest length of at most ``most``; 0 if none."""
        return max(0, (self.bits & ((1 << (most + 1)) - 1)).bit_length() - 1)

    def shortest(self) -> int:
        return (self.bits & -self.bits).bit_length() - 1 if self.bits else 0


def pack_block(documents: list, tiers: tuple[int, ...], last: bool) -> tuple[list, list]:
    """Sequences of (document, start, length) pieces, and what is left for the next block.

    ``documents`` holds (document, start, length) runs; with ``last`` nothing is left.
    """
    top, done, pool = tiers[-1], [], Pool()
    for doc, start, length in documents:
        while length >= top:
            done.append([(doc, start, top)])
            start, length = start + top, length - top
        if length:
            pool.add(length, (doc, start))
    rest = []
    for k in range(len(tiers) - 1, -1, -1):
        tier, below = tiers[k], tiers[k - 1] if k else 0
        while (head := pool.longest(tier)) > below:
            doc, start = pool.take(head)
            window, gap = [(doc, start, head)], tier - head
            while gap and pool.bits:
                if fit := pool.longest(gap):
                    doc, start = pool.take(fit)
                    window.append((doc, start, fit))
                    gap -= fit
                else:
                    long = pool.shortest()
                    doc, start = pool.take(long)
                    window.append((doc, start, gap))
                    pool.add(long - gap, (doc, start + gap))
                    gap = 0
            if gap:
                rest += window
            else:
                done.append(window)
    if last:
        done += cut_rest(rest, tiers)
        rest = []
    return done, rest


def cut_rest(rest: list, tiers: tuple[int, ...]) -> list:
    """The rest, end to end, in windows of tier lengths and at last powers of two."""
    total, done = sum(x[2] for x in rest), []
    sizes = sorted({*tiers, *(1 << b for b in range(tiers[0].bit_length()))}, reverse=True)
    runs = [list(x) for x in reversed(rest)]
    for size in sizes:
        while total >= size:
            window, need = [], size
            while need:
                doc, start, length = runs[-1]
                part = min(need, length)
                window.append((doc, start, part))
                need -= part
                if part == length:
                    runs.pop()
                else:
                    runs[-1] = [doc, start + part, length - part]
            done.append(window)
            total -= size
    return done


def step_groups(sequences: list, step_tokens: int) -> list[int]:
    """A group for each sequence: groups have like token budgets and like sums of squared piece lengths."""
    lengths = [sum(p[2] for p in s) for s in sequences]
    groups = max(1, round(sum(lengths) / step_tokens))
    order = sorted(range(len(sequences)), key=lambda k: (-lengths[k], -sum(p[2] ** 2 for p in sequences[k]), k))
    out = [0] * len(sequences)
    for rank, k in enumerate(order):
        lap, at = divmod(rank, groups)
        out[k] = at if lap % 2 == 0 else groups - 1 - at
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, tiers: tuple[int, ...] = TIERS, end_token: int = END_TOKEN, step_tokens: int = STEP_TOKENS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece: the id column and PIECES; token_bytes are the ids as little-endian unsigned 32-bit integers."""
    path, tiers = tokenizer_path or default_path(), tuple(sorted(tiers))
    if any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two, else full windows would be padded")
    own_id, own_text = fresh(PIECES.names, id_col, text_col)
    source = docs.select(F.col(f"`{id_col}`").alias(own_id), F.col(f"`{text_col}`").cast("string").alias(own_text))
    schema = T.StructType([source.schema[0], *PIECES])

    def run(batches):
        encoder = json_bpe(path)
        base = TaskContext.get().partitionId() << 36
        ids, tokens, runs, held = [], [], [], 0  # of the documents in hand
        next_sequence = next_group = base
        kind = None

        def flush(last):
            nonlocal ids, tokens, runs, held, next_sequence, next_group
            sequences, rest = pack_block(runs, tiers, last)
            groups = step_groups(sequences, step_tokens)
            cols = [[] for _ in range(10)]
            size = 0
            for seq, group in zip(sequences, groups):
                offset, total = 0, sum(p[2] for p in seq)
                tier = next((t for t in tiers if t >= total), tiers[-1])
                for doc, start, length in seq:
                    own = tokens[doc]
                    values = (ids[doc], start, length, len(own), next_sequence, offset, total, tier, next_group + group, own[start : start + length].tobytes())
                    for col, v in zip(cols, values):
                        col.append(v)
                    offset += length
                    size += length
                next_sequence += 1
                if size > 500_000:
                    yield batch(cols)
                    cols, size = [[] for _ in range(10)], 0
            if cols[0]:
                yield batch(cols)
            next_group += max(groups, default=-1) + 1
            keep = sorted({r[0] for r in rest})
            at = {d: k for k, d in enumerate(keep)}
            ids, tokens = [ids[d] for d in keep], [tokens[d] for d in keep]
            runs, held = [(at[d], s, n) for d, s, n in rest], sum(r[2] for r in rest)

        def batch(cols):
            kinds = [kind, *[pa.int64()] * 6, pa.int32(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[f.name for f in schema])

        for b in batches:
            kind = b.column(0).type
            for x, t in zip(b.column(0).to_pylist(), b.column(1)):
                own = np.append(encoder.encode(t.as_py() or ""), np.uint32(end_token)).astype("<u4")
                runs.append((len(tokens), 0, len(own)))
                ids.append(x)
                tokens.append(own)
                held += len(own)
                if held >= block_tokens:
                    yield from flush(False)
        if kind is not None:
            yield from flush(True)

    return source.mapInArrow(run, schema)
