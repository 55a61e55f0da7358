import pytest

from tabdelta.plans.align import aligned_names
from tabdelta.plans.headers import Styles, by_keys, by_reference, by_score, effective_rows, header_row, merge_detected
from tabdelta.plans.pairing import pair_files, unmatched, with_manual

GRID = [["Title", None, None], ["ID", "Name", "Code"], ["1", "Ann", "7"], ["2", "Bob", "8"], ["3", "Cy", "9"]]


def test_header_by_score_keys_and_reference():
    assert by_score(GRID) == 1
    assert by_keys(GRID, ["code"]) == 1 and by_keys(GRID, ["none"]) is None
    assert by_reference(GRID, ["id", "NAME", "other"]) == 1 and by_reference(GRID, ["x", "y"]) is None
    assert header_row(GRID, semantics="v1") == 1


def test_a_repeated_name_does_not_cost_a_header_its_row():
    names = [f"Name {k}" for k in range(11)] + ["Name 3"]
    grid = [names, *[[str(10 * r + c) if c else f"Ann {r}" for c in range(12)] for r in range(6)]]
    assert by_score(grid) == 0


def test_styles_decide():
    grid = [["a", "b", "c"], ["d", "e", "f"], ["1", "2", "3"], ["4", "5", "6"]]
    assert by_score(grid) == 0
    assert by_score(grid, Styles(bold={(1, 0), (1, 1), (1, 2)})) == 1
    assert by_score(grid, Styles(merges=[(0, 0, 0, 1)])) == 1
    assert by_score(grid, Styles(merges=[(0, 1, 0, 0)], bold={(1, 0), (1, 1), (1, 2)})) == 0


def test_merging_and_overrides():
    assert merge_detected([{"a": 1, "b": 3}, {"a": 2}]) == {"a": 2, "b": 3}
    assert effective_rows({"a": 2}, {"a": 5}) == {"a": 5}
    with pytest.raises(ValueError):
        effective_rows({}, {"a": 101})


def test_alignment():
    assert aligned_names(["id_1", "NAME", "Total Amount", "Paid"], ["ID", "Name", "Amount"]) == ["ID", "Name", "Amount", "Paid"]
    assert aligned_names(["id", "Paid"], ["ID"], revisit=True) == ["ID", "ID_1"]


def test_pairing():
    old, new = ["report_2023.xlsx", "x.csv"], ["other.csv", "report_2024.xlsx"]
    pairs = pair_files(old, new)
    assert [(p.old, p.new) for p in pairs] == [("report_2023.xlsx", "report_2024.xlsx")]
    assert unmatched(old, new, pairs) == (["x.csv"], ["other.csv"])
    assert [(p.old, p.new, p.origin) for p in with_manual(pairs, [("report_2023.xlsx", "other.csv")])] == [("report_2023.xlsx", "other.csv", "manual")]
    with pytest.raises(ValueError):
        pair_files(old, new, 0.2)
