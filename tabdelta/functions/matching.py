"""The Ratcliff-Obershelp ratio of many pairs of texts at once.

The longest common block of every open range of every pair is found together, by one table of run
lengths per range that advances one character of the first text a step; the ranges left and right of
the blocks are the next round's. Of blocks of equal length the first in the first text counts, then
the first in the second. Where a least ratio is asked for, a pair is given up once what is matched
and the shorter sides of its open ranges can't reach it.
"""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import numpy as np

#: From this length of the second text on, the measure leaves frequent characters out of its search (a fixed value of the measure); such pairs are matched one by one.
POPULAR_FROM = 200
CHUNK = 2048


def _codes(texts: Sequence[str], pad: int) -> np.ndarray:
    width = max(1, max(map(len, texts)))
    out = np.full((len(texts), width), pad, dtype=np.int32)
    for k, t in enumerate(texts):
        out[k, :len(t)] = [ord(c) for c in t]
    return out


def _window(codes: np.ndarray, pair: np.ndarray, lo: np.ndarray, hi: np.ndarray, pad: int) -> np.ndarray:
    """The characters of each range, padded to the longest."""
    at = lo[:, None] + np.arange((hi - lo).max())
    return np.where(at < hi[:, None], codes[pair[:, None], np.minimum(at, codes.shape[1] - 1)], pad)


def _longest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, end in a, end in b) of each row's longest common block."""
    n, width = b.shape
    size, end_a, end_b = (np.zeros(n, dtype=np.int64) for _ in range(3))
    runs = np.zeros((n, width + 1), dtype=np.int32)
    every = np.arange(n)
    for i in range(a.shape[1]):
        runs[:, 1:] = np.where(a[:, i, None] == b, runs[:, :-1] + 1, 0)
        at = runs.argmax(axis=1)
        most = runs[every, at]
        better = most > size
        size[better], end_a[better], end_b[better] = most[better], i + 1, at[better]
    return size, end_a, end_b


def matched(first: Sequence[str], second: Sequence[str], least: np.ndarray | None = None) -> np.ndarray:
    """Characters in common blocks per pair; a number below ``least`` where that can't be reached."""
    codes = _codes(first, -1), _codes(second, -2)
    total = np.zeros(len(first), dtype=np.int64)
    pair = np.arange(len(first))
    alo, blo = np.zeros_like(pair), np.zeros_like(pair)
    ahi, bhi = np.array([len(t) for t in first]), np.array([len(t) for t in second])
    while len(pair):
        keep = (ahi > alo) & (bhi > blo)
        if least is not None:
            left = np.bincount(pair[keep], np.minimum(ahi - alo, bhi - blo)[keep], len(total))
            keep &= (total + left >= least)[pair]
        pair, alo, ahi, blo, bhi = pair[keep], alo[keep], ahi[keep], blo[keep], bhi[keep]
        if not len(pair):
            break
        size, ea, eb = _longest(_window(codes[0], pair, alo, ahi, -1), _window(codes[1], pair, blo, bhi, -2))
        total += np.bincount(pair, size, len(total)).astype(np.int64)
        hit = size > 0
        pair, size, alo, ahi, blo, bhi, ea, eb = (x[hit] for x in (pair, size, alo, ahi, blo, bhi, alo + ea, blo + eb))
        pair = np.concatenate([pair, pair])
        alo, ahi, blo, bhi = np.concatenate([alo, ea]), np.concatenate([ea - size, ahi]), np.concatenate([blo, eb]), np.concatenate([eb - size, bhi])
    return total


def ratios(first: Sequence[str], second: Sequence[str], least: float | None = None) -> np.ndarray:
    """2M / T per pair, 1 for two empty texts; with ``least``, ratios below it are lower bounds alone."""
    out = np.ones(len(first))
    short = [k for k in range(len(first)) if len(second[k]) < POPULAR_FROM]
    for k in set(range(len(first))) - set(short):
        out[k] = SequenceMatcher(None, first[k], second[k]).ratio()
    short.sort(key=lambda k: len(first[k]))  # texts of like length share a chunk
    for at in range(0, len(short), CHUNK):
        part = short[at:at + CHUNK]
        a, b = [first[k] for k in part], [second[k] for k in part]
        both = np.array([len(x) + len(y) for x, y in zip(a, b)])
        m = matched(a, b, None if least is None else np.ceil(least * both / 2 - 1e-9))
        out[part] = np.where(both > 0, 2.0 * m / np.maximum(both, 1), 1.0)
    return out
