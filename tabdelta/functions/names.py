"""Names of columns, files and sheets: plain Python for schema-sized input, Columns for tables of names."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, functions as F

_OTHER = "[^a-z0-9]"
_SUFFIX = {"v1": r"(_\d+)+$", "v2": r"([_.]\d+)+$"}


def plain_name(name) -> str:
    """Letters and digits of a name, lowered."""
    return re.sub(_OTHER, "", str(name).strip().lower())


def match_name(name, semantics: str = "v2") -> str:
    """A name without trailing numeric suffixes, for alignment."""
    return re.sub(_OTHER, "", re.sub(_SUFFIX[semantics], "", str(name).strip().lower()))


def key_name(name, semantics: str = "v2") -> str:
    """A key's name for similarity; v1 keeps the suffix."""
    base = str(name).strip().lower()
    return re.sub(_OTHER, "", base if semantics == "v1" else re.sub(_SUFFIX["v1"], "", base))


def comparable(file_name: str, ignore_suffix: bool = False) -> str:
    """A file name without its extension and, on request, without the text after its last underscore."""
    base = file_name.rsplit(".", 1)[0] if "." in file_name else file_name
    if ignore_suffix and "_" in base:
        base = base.rsplit("_", 1)[0]
    return base.lower()


def similarity(a: str, b: str) -> float:
    """Ratcliff-Obershelp ratio; depends on the order of its arguments."""
    return SequenceMatcher(None, a, b).ratio()


def extension(file_name: str) -> str:
    return file_name.rsplit(".", 1)[1].lower() if "." in file_name else ""


def sheet_name(file_name: str) -> str:
    """The sheet a delimited file stands for: its stem."""
    return re.split(r"[\\/]", file_name)[-1].rsplit(".", 1)[0]


def parse_keys(text: str) -> list[str]:
    return [k.strip() for k in text.split(",") if k.strip()]


def header_index(shown: int) -> int:
    """The 0-based row of a 1-based row number."""
    return max(0, int(shown) - 1)


def unique_names(names: list) -> list[str]:
    """Stripped names; blank ones become Unnamed_<i>, repeats get the next free _<n>."""
    wanted = []
    for i, name in enumerate(names):
        text = "" if name is None else str(name).strip()
        wanted.append(f"Unnamed_{i}" if text in ("", "nan") else text)
    out, taken, reserved = [], set(), set(wanted)
    for name in wanted:
        candidate, n = name, 0
        while candidate in taken or (n and candidate in reserved):
            n += 1
            candidate = f"{name}_{n}"
        taken.add(candidate)
        out.append(candidate)
    return out


def fresh(taken, *wanted: str) -> list[str]:
    """Names for internal columns that differ from those taken, letter case aside."""
    low, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in low:
            name = f"_{name}"
        low.add(name.lower())
        out.append(name)
    return out


# The same functions over columns of names.
def plain_name_column(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), _OTHER, "")


def match_name_column(c: Column, semantics: str = "v2") -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), _SUFFIX[semantics], ""), _OTHER, "")


def comparable_column(c: Column, ignore_suffix: bool = False) -> Column:
    base = F.regexp_replace(c, r"\.[^.]*$", "")
    return F.lower(F.regexp_replace(base, r"_[^_]*$", "") if ignore_suffix else base)


def extension_column(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"\.([^.]+)$", 1))


def sheet_name_column(c: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(c, r"([^\\/]+)$", 1), r"\.[^.]*$", "")


def similarity_column(a: Column, b: Column) -> Column:
    """The ratio over columns, by an Arrow-batched function: Spark has no built-in of this measure."""
    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y)], dtype="float64")

    return ratio(a, b)


def looks_numeric(name: str) -> Column:
    """Of a column: digits with at most one point and one minus sign anywhere."""
    return F.regexp_replace(F.regexp_replace(name, r"^([^.]*)\.", "$1"), r"^([^-]*)-", "$1").rlike(r"^\d+$")


def looks_like_name(name: str) -> Column:
    """Of a column: text of under 40 characters that starts with a letter."""
    return (F.length(name) < 40) & F.trim(name).rlike(r"^[A-Za-z]")
