"""Finding the header row of a sheet from its first rows.

A grid is a list of rows of cells; a cell is None, a text, or any other value (typed
cells exist only in workbooks). Style facts come as a Styles value.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from statistics import stdev

from ..functions.names import plain_name

SCAN_ROWS = 15
LOOK_AHEAD = 8
#: Rows a reader must deliver for any decision here.
ROWS_NEEDED = SCAN_ROWS + LOOK_AHEAD
#: How much each sign of a header counts, and what is taken off per row above and for a merged group label.
BOLD, FILL, ALL_TEXT, UNIQUE, NAME_LIKE, STEADY, NOT_NUMERIC, PER_ROW, GROUP_LABEL = 3.0, 1.5, 1.0, 1.0, 1.0, 1.0, 0.5, 0.1, 2.5


@dataclass
class Styles:
    """bold: (row, col) of bold cells; merges: (first row, last row, first col, last col), all from 0."""

    bold: set[tuple[int, int]] = field(default_factory=set)
    merges: list[tuple[int, int, int, int]] = field(default_factory=list)


def filled(row: Sequence) -> list:
    return [v for v in row if v is not None and str(v).strip() not in ("", "nan")]


def by_reference(grid: Sequence[Sequence], reference: Sequence[str]) -> int | None:
    """The row that holds most reference names: at least two and half of them; four fifths decide at once."""
    want = {plain_name(r) for r in reference} - {""}
    best, most = None, 0
    for i, row in enumerate(grid[:SCAN_ROWS]):
        hits = len(want & {plain_name(v) for v in filled(row)})
        if hits >= max(2, 0.5 * len(want)) and hits > most:
            best, most = i, hits
            if hits >= 0.8 * len(want):
                return i
    return best


def by_keys(grid: Sequence[Sequence], keys: Sequence[str]) -> int | None:
    """The first row with a cell that is one of the key names."""
    want = {plain_name(k) for k in keys} - {""}
    return next((i for i, row in enumerate(grid[:SCAN_ROWS]) if want & {plain_name(v) for v in filled(row)}), None)


def numeric_text(value) -> bool:
    """Digits with at most one point and one minus sign anywhere."""
    return str(value).replace(".", "", 1).replace("-", "", 1).isdigit()


def score_row(grid: Sequence[Sequence], i: int, styles: Styles) -> float | None:
    """How much row i looks like a header; None where it can't be one."""
    row = grid[i]
    at = [c for c, v in enumerate(row) if v is not None and str(v).strip() not in ("", "nan")]
    if len(at) < 2 or any(lo < i <= hi for lo, hi, _, _ in styles.merges):
        return None
    values = [row[c] for c in at]
    n = len(values)
    texts = [v for v in values if isinstance(v, str)]
    bold = sum((i, c) in styles.bold for c in at) / n
    fill = n / max(1, len(row))
    all_text = len(texts) == n
    unique = len({str(v) for v in values}) / n
    name_like = sum(len(v) < 40 and bool(re.match(r"[A-Za-z]", v.strip())) for v in texts) / n
    numbers = sum(numeric_text(v) for v in values) / n
    below = [len(filled(r)) for r in grid[i + 1 : i + 1 + LOOK_AHEAD]]
    steady = 1 / (1 + stdev(below)) if len(below) > 1 else 0.0
    score = BOLD * bold + FILL * fill + ALL_TEXT * all_text + UNIQUE * unique + NAME_LIKE * name_like + STEADY * steady + NOT_NUMERIC * (1 - numbers) - PER_ROW * i
    return score - GROUP_LABEL * any(lo == hi == i for lo, hi, _, _ in styles.merges)


def by_score(grid: Sequence[Sequence], styles: Styles | None = None) -> int:
    """The best-scoring row; the earliest of equals; row 0 where none scores above -1."""
    best, most = 0, -1.0
    for i in range(min(SCAN_ROWS, len(grid))):
        s = score_row(grid, i, styles or Styles())
        if s is not None and s > most:
            best, most = i, s
    return best


def by_ratios(grid: Sequence[Sequence]) -> int:
    """The older rule: the first row that is filled, textual and contiguous enough."""
    scan = grid[:SCAN_ROWS]
    widest = max((len(filled(r)) for r in scan), default=0)
    for i, row in enumerate(scan):
        values = filled(row)
        if len(values) < 2 or not widest:
            continue
        run = longest = 0
        for v in row:
            run = run + 1 if v is not None and str(v).strip() not in ("", "nan") else 0
            longest = max(longest, run)
        if len(values) / widest >= 0.4 and sum(isinstance(v, str) for v in values) / len(values) >= 0.5 and longest / len(row) > 0.5:
            return i
    return 0


def header_row(grid: Sequence[Sequence], keys: Sequence[str] = (), reference: Sequence[str] = (), styles: Styles | None = None, semantics: str = "v2") -> int:
    """The header's 0-based row: by reference names, then by key names, then by look."""
    if reference and (found := by_reference(grid, reference)) is not None:
        return found
    if keys and (found := by_keys(grid, keys)) is not None:
        return found
    return by_ratios(grid) if semantics == "v1" else by_score(grid, styles)


def merge_detected(found: Sequence[dict[str, int]]) -> dict[str, int]:
    """Per sheet name the greatest 1-based row over all files, at least 1."""
    out: dict[str, int] = {}
    for one in found:
        for sheet, row in one.items():
            out[sheet] = max(out.get(sheet, 1), row)
    return out


def effective_rows(detected: dict[str, int], overrides: dict[str, int] | None) -> dict[str, int]:
    """1-based rows after overrides; an override outside 1..100 is refused."""
    for sheet, row in (overrides or {}).items():
        if not 1 <= row <= 100:
            raise ValueError(f"header row {row} of {sheet!r} is outside 1..100")
    return {**detected, **{s: r for s, r in (overrides or {}).items()}}
