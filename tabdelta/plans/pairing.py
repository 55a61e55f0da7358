"""Pairing OLD and NEW files by name."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from ..functions.names import comparable, similarity

THRESHOLD = 0.85


@dataclass(frozen=True)
class Pair:
    old: str
    new: str
    ratio: float
    origin: str = "auto"


def pair_files(old: Sequence[str], new: Sequence[str], threshold: float = THRESHOLD, ignore_suffix: bool = False) -> list[Pair]:
    """Each OLD name, in order, takes the most similar free NEW name (the first of equals) of at least the threshold."""
    if not 0.5 <= threshold <= 1.0:
        raise ValueError("the threshold lies between 0.5 and 1")
    free, out = list(range(len(new))), []
    for o in old:
        best, most = None, 0.0
        for k in free:
            r = similarity(comparable(o, ignore_suffix), comparable(new[k], ignore_suffix))
            if r > most:
                best, most = k, r
        if best is not None and most >= threshold:
            free.remove(best)
            out.append(Pair(o, new[best], most))
    return out


def with_manual(auto: Sequence[Pair], manual: Sequence[tuple[str, str]]) -> list[Pair]:
    """Manual pairs replace automatic pairs of the same OLD file and come last."""
    own = {o for o, _ in manual}
    return [p for p in auto if p.old not in own] + [Pair(o, n, 1.0, "manual") for o, n in manual]


def unmatched(old: Sequence[str], new: Sequence[str], pairs: Sequence[Pair]) -> tuple[list[str], list[str]]:
    left, right = {p.old for p in pairs}, {p.new for p in pairs}
    return [o for o in old if o not in left], [n for n in new if n not in right]
