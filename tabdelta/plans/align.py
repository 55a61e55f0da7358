"""Aligning the column names of NEW with those of OLD."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions.names import match_name, unique_names
from ..operators.keyed import ORDER


def aligned_names(new: Sequence[str], old: Sequence[str], semantics: str = "v2", revisit: bool = False) -> list[str]:
    """NEW's names rewritten to OLD's.

    First equal normalised names are matched, then names of which one contains the
    other, each to the first free NEW column. A reference that is matched, or whose
    normalised name is empty, isn't matched again unless ``revisit``.
    """
    norm_new = [match_name(c, semantics) for c in new]
    target: dict[int, str] = {}
    matched = set()
    for k, ref in enumerate(old):
        want = match_name(ref, semantics)
        at = next((i for i, n in enumerate(norm_new) if i not in target and n == want), None)
        if at is not None and (want or revisit):
            target[at] = ref
            matched.add(k)
    for k, ref in enumerate(old):
        want = match_name(ref, semantics)
        if not revisit and (k in matched or not want):
            continue
        at = next((i for i, n in enumerate(norm_new) if i not in target and (revisit or n) and (want in n or n in want)), None)
        if at is not None:
            target[at] = ref
    return unique_names([target.get(i, c) for i, c in enumerate(new)])


def align(new: DataFrame, old: DataFrame, semantics: str = "v2", revisit: bool = False) -> DataFrame:
    hidden = [c for c in new.columns if c == ORDER]
    shown = [c for c in new.columns if c != ORDER]
    names = aligned_names(shown, [c for c in old.columns if c != ORDER], semantics, revisit)
    return new.select(*[new[f"`{c}`"].alias(n) for c, n in zip(shown, names)], *[new[f"`{c}`"] for c in hidden])
