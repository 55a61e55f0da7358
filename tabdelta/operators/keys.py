"""Choosing a key: by similarity of names on the driver and by uniqueness of values in one pass per side."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.names import key_name, similarity

MIN_SIMILARITY = 0.8


def uniqueness(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Distinct values (a missing one counts as a value) per row, for all columns in one aggregate."""
    if not columns:
        return {}
    got = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).alias(f"c{k}") for k, c in enumerate(columns)]).first()
    return {c: got[f"c{k}"] / max(1, got["n"]) for k, c in enumerate(columns)}


def uniqueness_frame(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """(column, uniqueness): the mean of both sides, as one plan."""
    def side(df: DataFrame, name: str) -> DataFrame:
        one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).alias(f"c{k}") for k, c in enumerate(columns)])
        return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), (F.col(f"c{k}") / F.greatest(F.lit(1), F.col("n"))).alias(name)) for k, c in enumerate(columns)])).alias("x")).select("x.*")

    return side(old, "u_old").join(side(new, "u_new"), "column").select("column", ((F.col("u_old") + F.col("u_new")) / 2).alias("uniqueness"))


def named_like(key: str, old: list[str], new: list[str], semantics: str = "v2") -> tuple[str, str] | None:
    """The pair of columns whose names are most like the key's, both by at least MIN_SIMILARITY.

    Of columns whose names come to the same, the last stands for all; of pairs that are equally like, the first is taken.
    """
    left, right = ({key_name(c, semantics): c for c in columns} for columns in (old, new))
    want, best, score = key_name(key, semantics), None, 0.0
    theirs = [(rb, b) for n, b in right.items() if (rb := similarity(want, n)) >= MIN_SIMILARITY]
    for n, a in left.items():
        ra = similarity(want, n)
        if ra < MIN_SIMILARITY:
            continue
        for rb, b in theirs:
            if (ra + rb) / 2 > score:
                best, score = (a, b), (ra + rb) / 2
    return best


def choose_key(old: DataFrame, new: DataFrame, keys: list[str], semantics: str = "v2", composite: bool = False) -> tuple[list[str], str]:
    """The key columns (OLD's names) and a description by the keys as they were asked for; no columns where none is valid.

    One column is chosen, the most unique; with ``composite`` all valid ones are.
    """
    if not keys:
        return [], "No keys provided"
    asked: dict[str, str] = {}  # column -> the key that found it first
    for k in keys:
        pair = named_like(k, old.columns, new.columns, semantics)
        if pair and pair[0] in new.columns:
            asked.setdefault(pair[0], k)
    if not asked:
        return [], "No valid keys found"
    candidates = list(asked)
    u_old, u_new = uniqueness(old, candidates), uniqueness(new, candidates)
    scores = {c: (u_old[c] + u_new[c]) / 2 for c in candidates}
    said = lambda c: f"'{asked[c]}' ({scores[c]:.0%} unique)"
    if composite and len(candidates) > 1:
        return candidates, "Key: " + ", ".join(map(said, candidates))
    best = max(candidates, key=lambda c: scores[c])  # the first of equals
    return [best], f"Key: {said(best)}"
