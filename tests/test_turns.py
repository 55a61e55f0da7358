"""Components too large for a task: turns give the rule's assignment and list no pairs of rows."""

import random

import pytest

from tabdelta.operators import blocks, reconcile
from tabdelta.operators.blocks import match_rows
from tabdelta.operators.reconcile import assign_in_order


@pytest.mark.parametrize("source", ["blocks", "pairs"])
@pytest.mark.parametrize("n_columns, threshold, constant", [(4, 0.5, 0), (4, 0.5, 2)])
def test_turns_keep_the_rule(spark, monkeypatch, source, n_columns, threshold, constant):
    def refused(*_, **__):
        raise AssertionError("pairs of rows were listed")

    monkeypatch.setattr(reconcile, "candidate_pairs", refused)
    monkeypatch.setattr(blocks, "candidate_pairs", refused, raising=False)
    rng = random.Random(5)
    cell = lambda k: "same" if k < constant else rng.choice("abcd")
    rows = [[tuple(cell(k) for k in range(n_columns)) for _ in range(n)] for n in (50, 40)]
    columns = [f"x{k}" for k in range(n_columns)]
    frames = [spark.createDataFrame([(3 * i, *row) for i, row in enumerate(side)], f"{rid} long, " + ", ".join(f"{c} string" for c in columns)) for side, rid in zip(rows, ("ri", "ai"))]
    same = [(3 * i, 3 * j, sum(x == y for x, y in zip(r, a))) for i, r in enumerate(rows[0]) for j, a in enumerate(rows[1])]
    want = assign_in_order(e for e in same if e[2] >= threshold * n_columns)
    got = match_rows(*frames, columns, threshold, giant=5, source=source, at_once=20)
    assert sorted((m.ri, m.ai) for m in got.collect()) == sorted(want)


def test_a_cut_list_stops_the_turn():
    import pyarrow as pa

    from tabdelta.operators.turns import CUT, LISTED, PLACES, TURN, take_turn  # noqa: F401

    one = [{"size": 1.0, "p": 7, "q": 0}]
    kind = pa.struct([("size", pa.float64()), ("p", pa.int64()), ("q", pa.int64())])
    entries = [(LISTED, 7, 0, 4, None), (CUT, 7, 0, 9, None), (TURN, 1, 0, 1, one), (TURN, 2, 0, 2, one), (TURN, 3, 0, 3, one)]
    batch = pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in list(zip(*entries))[:4]), pa.array([e[4] for e in entries], pa.list_(kind))], names=["kind", "p", "q", "id", "places"])
    assert [b.to_pydict() for b in take_turn(iter([batch]))] == [{"ri": [1], "ai": [4]}]
