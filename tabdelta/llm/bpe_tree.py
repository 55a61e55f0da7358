"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is halved until a leaf is short, leaves are encoded, and neighbours are
joined up the tree. A join re-encodes a window round the boundary that grows
until both its ends are sync points: places where the split pattern ends a match
whatever stands further away, so tokens outside the window can't change. A sync
point lies
* before a blank that follows a non-blank: no match holds the two, and the pattern
  looks ahead only inside runs of blanks;
* before a digit or a mark that follows a letter, and before a letter or a mark that
  follows a digit: no match holds two of these classes in this order;
* before a digit that follows a mark, and before a letter that follows a mark other
  than the apostrophe, which contractions start with.
Only characters on whose class all Unicode versions agree count as letters, digits
and marks. Joining is associative, with the empty list as its identity. Decoding
concatenates token bytes up a tree of the same shape.

Defined results: a null text counts as empty and has no tokens; every row gives one
row, repeated rows included; columns named like a result column are replaced. A
stretch without any sync point (one word of letters, however long) is re-encoded
whole at the joins inside it, which is right but slower. Memory is that of one text
and its ids.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .shared import fresh, without

RANKS_FILE = "byte_bpe_50k.tiktoken"
LEAF_CHARS = 4096
WINDOW_CHARS = 32
_BLANKS = frozenset(" \t\n\r\x0b\x0c")


#: Ranges of letters, digits and marks (neither letter, digit nor blank) old enough to be in every Unicode version.
_LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f\u0410-\u044f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
_DIGITS = "0-9"
_MARKS = "!-/:-@\\[-`{-~\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f"
_SYNC = re.compile(f"[{_LETTERS}][{_DIGITS}{_MARKS}]|[{_DIGITS}][{_LETTERS}{_MARKS}]|[{_MARKS}][{_DIGITS}]|(?!')[{_MARKS}][{_LETTERS}]")


def is_sync(text: str, at: int) -> bool:
    """Whether a match boundary lies before text[at] in every text that has these two characters here."""
    if text[at] in _BLANKS:
        return not text[at - 1].isspace()
    return _SYNC.match(text, at - 1, at + 1) is not None


class TreeBpe:
    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN, leaf: int = LEAF_CHARS, window: int = WINDOW_CHARS):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.leaf, self.window = max(1, leaf), max(1, window)

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf:
            return self.encoding.encode_ordinary(text[lo:hi])
        mid = (lo + hi) // 2
        return self.join(text, lo, mid, hi, self._encode(text, lo, mid), self._encode(text, mid, hi))

    def join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        """The ids of text[lo:hi] from those of its parts."""
        if lo < mid < hi and is_sync(text, mid):
            return left + right
        a, b = self._stable(text, lo, mid, hi)
        return left[: len(left) - self._count(left, -1, text[a:mid])] + self.encoding.encode_ordinary(text[a:b]) + right[self._count(right, 1, text[mid:b]) :]

    def _stable(self, text: str, lo: int, mid: int, hi: int) -> tuple[int, int]:
        """The ends of the least window of doubling size that both lie on sync points, or at the ends of the text."""
        width, a, b = self.window, None, None
        while a is None or b is None:
            if a is None:
                a = next((p for p in range(mid - 1, max(lo, mid - width), -1) if is_sync(text, p)), lo if mid - width <= lo else None)
            if b is None:
                b = next((p for p in range(mid + 1, min(hi, mid + width)) if is_sync(text, p)), hi if mid + width >= hi else None)
            width *= 2
        return a, b

    def _count(self, ids: list[int], step: int, part: str) -> int:
        """How many ids at the end (step -1) or the start (step 1) spell the part."""
        need, n = len(part.encode()), 0
        while need > 0:
            need -= len(self.bytes_of[ids[n if step > 0 else -1 - n]])
            n += 1
        return n

    def decode(self, ids) -> bytes:
        n = len(ids)
        if n <= self.leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        return self.decode(ids[: n // 2]) + self.decode(ids[n // 2 :])


@lru_cache(maxsize=2)
def tree_bpe(path: str, leaf: int, window: int) -> TreeBpe:
    return TreeBpe(path, leaf=leaf, window=window)


def default_path() -> str:
    return public_tokenizers.path(RANKS_FILE)


def encode_decode(docs: DataFrame, text_col: str = "text", ranks_path: str | None = None, leaf: int = LEAF_CHARS, window: int = WINDOW_CHARS, flush_bytes: int = 2 << 20) -> DataFrame:
    """docs without the text, with n_tokens, token_ids and decoded (the bytes the ids stand for)."""
    path = ranks_path or default_path()
    kept = without(docs, "n_tokens", "token_ids", "decoded", text_col)
    (own_text,) = fresh(kept.columns, "text")
    source = docs.select(F.col(f"`{text_col}`").cast("string").alias(own_text), *[F.col(f"`{c}`") for c in kept.columns])
    schema = T.StructType([*kept.schema, T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])

    def run(batches):
        codec = tree_bpe(path, leaf, window)
        for b in batches:
            start, size, ids, decoded = 0, 0, [], []
            for k, t in enumerate(b.column(0)):
                text = t.as_py() or ""
                own = codec.encode(text)
                ids.append(np.array(own, np.int32))
                decoded.append(codec.decode(own))
                size += len(text)
                if size >= flush_bytes or k + 1 == b.num_rows:
                    counts = np.array([len(x) for x in ids], np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(np.concatenate(ids)))
                    rest = b.slice(start, k + 1 - start)
                    yield pa.RecordBatch.from_arrays([*rest.columns[1:], pa.array(counts), lists, pa.array(decoded, pa.binary())], names=[f.name for f in schema])
                    start, size, ids, decoded = k + 1, 0, [], []

    return source.mapInArrow(run, schema)
