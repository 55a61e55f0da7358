"""Extra columns named like anything an operator uses inside, and odd rows, for every operator."""

import re
from pathlib import Path

import pytest

import tabdelta.llm as llm
from tabdelta.llm import bpe_tree, exact_dedup, jaccard_join, language_id, license_scan, packing, pii, quality_rules, suffix_dedup, token_counts

KEY = b"a test key of some length"
RUNS = {
    "packing": (lambda d: packing.pack(d), set(packing.PIECES.names)),
    "bpe_tree": (lambda d: bpe_tree.encode_decode(d), {"n_tokens", "token_ids", "decoded"}),
    "quality_rules": (lambda d: quality_rules.ledger(d), {*quality_rules.MEASURES.names, "fail_bits"}),
    "exact_dedup": (lambda d: exact_dedup.exact_dedup(d), set(exact_dedup.RESULT)),
    "license_scan": (lambda d: license_scan.license_scan(d), {"license_ids", "n_units", "whole_text"}),
    "token_counts": (lambda d: token_counts.suffix_sums(token_counts.histogram(token_counts.token_lengths(d))), set()),
    "suffix_dedup": (lambda d: suffix_dedup.suffix_dedup(d, threshold=30, digit=10), set(suffix_dedup.RESULT)),
    "jaccard_join": (lambda d: jaccard_join.jaccard_components(d), {"n_shingles", "component_id"}),
    "pii": (lambda d: pii.pseudonymise(d, key=KEY), {"n_pseudonyms", *(f"n_{k}" for k in pii.KINDS)}),
    "language_id": (lambda d: language_id.identify(d, MODEL, host_col="source"), {"language", "posterior", "text_language", "n_grams"}),
    "one_of_each": (lambda d: jaccard_join.one_of_each(d), set()),
    "deduplicated": (lambda d: exact_dedup.deduplicated(d), set()),
    "keep_good": (lambda d: quality_rules.keep_good(d), set()),
}
DROPS_REST = {"packing", "license_scan", "token_counts"}
MODEL = language_id.TextModel.fit({"de": language_id.gram_counts(b"der und die das nicht ist"), "en": language_id.gram_counts(b"the and of that not is")})


def inner_names() -> list[str]:
    """Every name in quotes in the operators' code that could be a column."""
    found = set()
    for f in Path(llm.__file__).parent.glob("*.py"):
        if f.name not in ("queries.py", "license_texts.py"):
            found |= set(re.findall(r"[\"'`.]([A-Za-z_]\w{0,14})[\"'`]", f.read_text(encoding="utf-8")))
    low = {}
    for name in sorted(found | {"_text", "_n", "__row", "__best", "__text__", "fused", "host_share", "said_ll", "suffix_ll"}):
        low.setdefault(name.lower(), name)
    return [n for n in low.values() if n.lower() not in ("doc_id", "text", "source")]


TEXT = " ".join(f"word{k} thing{k % 7}" for k in range(40))
LONG = " ".join(f"w{k % 977}x{k}" for k in range(60_000))
ODD = [(1, TEXT), (2, TEXT), (2, TEXT), (3, None), (None, ""), (None, TEXT + " end"), (4, " \n\t"), (5, LONG), (6, LONG), (7, "4111111111111111 the.72@mail3.example.com")]


@pytest.mark.parametrize("name", sorted(RUNS))
def test_columns_of_any_name(spark, name):
    run, own = RUNS[name]
    extra = inner_names()
    assert len(extra) > 100
    rows = [(i, t, "s", *(f"{c}-{k}" for c in extra)) for k, (i, t) in enumerate(ODD)]
    clashing = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in extra)).coalesce(2)
    plain = clashing.select("doc_id", "text", "source")
    got, want = run(clashing), run(plain)
    shown = [c for c in want.columns if c != "step_group"]
    key = lambda df: sorted(str([r[c] for c in shown]) for r in df.select(shown).collect())
    if name == "pii":  # results replace columns of their names
        shown = [c for c in shown if c in own or c in ("doc_id", "text")]
    assert key(got) == key(want)
    if name not in DROPS_REST:
        kept = [c for c in extra if c.lower() not in {x.lower() for x in own}]
        assert set(kept) <= set(got.columns) and len(got.columns) == len({c.lower() for c in got.columns})
        for r in got.select(kept).collect():  # an extra column keeps its own values, all from one row
            assert {x.split("-")[0] for x in r} == set(kept) or [x.rsplit("-", 1)[0] for x in r] == kept
            assert len({x.rsplit("-", 1)[1] for x in r}) == 1


@pytest.mark.parametrize("name", sorted(RUNS))
def test_empty_table(spark, name):
    assert RUNS[name][0](spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_id_column_of_any_name_and_case(spark):
    df = spark.createDataFrame(ODD, "start long, text string")
    assert packing.pack(df, id_col="start").columns[0] == "_start"
    upper = spark.createDataFrame(ODD, "Doc_ID long, Text string")
    assert exact_dedup.exact_dedup(upper).count() == len(ODD) and exact_dedup.deduplicated(upper).columns == ["Doc_ID", "Text"]


def test_very_long_texts(spark):
    rows = [(1, LONG * 8), (2, LONG * 8 + " x"), (3, "a" * 3_000_000), (4, "日本語。" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert {r.doc_id: r.n_words for r in quality_rules.ledger(df).collect()} == {i: len(t.split()) for i, t in rows}
    assert {r.doc_id: r.n_grams for r in language_id.identify(df, MODEL).collect()} == {i: len(t.encode()) for i, t in rows}
    assert all(r.n_pseudonyms == 0 for r in pii.pseudonymise(df, key=KEY).collect())
    assert all(r.license_ids == [] for r in license_scan.license_scan(df).collect())
    same = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(df).collect()}
    assert same == {1: 1, 2: 1, 3: 3, 4: 4}


def test_hot_text_merged_by_salt(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_REPS", 3)
    rows = [(k, "hot" if k % 3 else f"t{k % 40}") for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(df, window_bytes=50).collect()}
    by = {}
    for i, t in rows:
        by.setdefault(t, []).append(i)
    assert got == {i: (max(by[t]), len(by[t])) for i, t in rows}
