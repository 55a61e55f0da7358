"""Assignment from distinct rows and blocks against the rule itself."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tabdelta.operators.blocks import Reconciled, match_rows
from tabdelta.operators.reconcile import GIANT, assign_in_order


def rule(removed, added, threshold):
    """The assignment by comparing every pair; rows are (id, cells...)."""
    need = max(1, math.ceil(threshold * (len(removed[0]) - 1) - 1e-12))
    edges = [(r[0], a[0], n) for r in removed for a in added if (n := sum(x == y for x, y in zip(r[1:], a[1:]))) >= need]
    return sorted(assign_in_order(edges))


def sides(spark, removed, added):
    cols = [f"c{k}" for k in range(len(removed[0]) - 1)]
    schema = ", ".join(f"{c} string" for c in cols)
    return spark.createDataFrame(removed, f"ri long, {schema}").repartition(3), spark.createDataFrame(added, f"ai long, {schema}").repartition(2), cols


def random_rows(rnd, n, domains):
    ids = rnd.sample(range(10 * n), n)
    return [(i, *[f"v{rnd.randrange(d)}" for d in domains]) for i in ids]


@pytest.mark.parametrize("source", ["pairs", "blocks", None])
@pytest.mark.parametrize("domains, threshold", [
    ((3, 3, 40, 60), 0.5),  # many equal rows and ties
    ((1, 1, 5, 30), 0.5),  # half the columns are constant: every pair qualifies
    ((1, 6, 6, 50, 50), 0.6),  # one constant column
    ((1, 1, 1), 0.5),  # all rows are equal
    ((60, 60, 60, 60), 0.5),  # many small components
    ((4, 4), 1.0),
])
def test_the_assignment_is_that_of_the_rule(spark, source, domains, threshold):
    rnd = random.Random(f"{domains}")
    removed, added = random_rows(rnd, 90, domains), random_rows(rnd, 70, domains)
    r, a, cols = sides(spark, removed, added)
    assert sorted(map(tuple, match_rows(r, a, cols, threshold, source=source).collect())) == rule(removed, added, threshold)


def test_components_that_are_too_large_for_a_task_go_through_rounds(spark):
    rnd = random.Random(8)
    removed, added = random_rows(rnd, 60, (3, 20, 20)), random_rows(rnd, 60, (3, 20, 20))
    r, a, cols = sides(spark, removed, added)
    assert sorted(map(tuple, match_rows(r, a, cols, 0.6, giant=40).collect())) == rule(removed, added, 0.6)


def test_cells_longer_than_a_digest_and_cells_that_look_like_one(spark):
    long = "x" * 5000
    removed = [(1, long + "A", "P"), (2, "", "Q"), (3, "Z" * 64, "")]
    added = [(5, long + "B", "R"), (6, long + "A", "S"), (7, "", "T"), (8, "Z" * 63, "U")]
    r, a, cols = sides(spark, removed, added)
    assert sorted(map(tuple, match_rows(r, a, cols).collect())) == [(1, 6), (2, 7)]


def test_empty_sides_no_columns_and_a_threshold_of_nothing(spark):
    r, a, cols = sides(spark, [(1, "x", "y")], [(2, "x", "z")])
    assert match_rows(r.limit(0), a, cols).count() == match_rows(r, a.limit(0), cols).count() == match_rows(r, a, []).count() == 0
    assert match_rows(r.limit(0), a.limit(0), cols).count() == 0
    with pytest.raises(ValueError):
        match_rows(r, a, cols, 0)


def test_internal_names_as_data_columns(spark):
    cols = ["id", "cells", "node", "label", "kind", "n", "c0", "c1", "v", "c", "of", "rn", "an", "ri2", "row2", "freq", "u"]
    r = spark.createDataFrame([(4, *["x"] * len(cols))], "ri long, " + ", ".join(f"{c} string" for c in cols))
    a = spark.createDataFrame([(9, *["x"] * (len(cols) - 3), "p", "q", "z")], "ai long, " + ", ".join(f"{c} string" for c in cols))
    assert [tuple(x) for x in match_rows(r, a, cols).collect()] == [(4, 9)]


def test_a_hundred_thousand_rows_a_side_with_half_the_columns_constant(spark):
    """Listed by pairs of rows these would be 10^10."""
    n = 100_000
    side = lambda rid, seed: spark.range(n).select(F.col("id").alias(rid), F.lit("A").alias("a"), F.lit("").alias("b"), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(300))).cast("string").alias("c"), (F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(7))).cast("string").alias("d"))
    got = match_rows(side("ri", 1), side("ai", 10), ["a", "b", "c", "d"])
    plan = got._jdf.queryExecution().toString()
    assert "CollectLimit" not in plan and GIANT < n * n
    assert got.count() == got.select("ri").distinct().count() == got.select("ai").distinct().count() == n


def test_reconciled_by_rows_of_half_constant_columns(spark):
    n, schema = 20_000, "a string, b string, c string, d string"
    rows = lambda rid, off: spark.range(n).select(F.col("id").alias(rid), F.lit("k").alias("a"), F.lit("k").alias("b"), (F.col("id") + off).cast("string").alias("c"), F.lit("0").alias("d"))
    rec = Reconciled(rows("ri", 0), rows("ai", 5), [c.split()[0] for c in schema.split(", ")])
    assert rec.matches.count() == n and rec.still_removed().count() == rec.still_added().count() == 0
    # Row k equals added row k - 5 in all columns; the first five have no equal and take what is free when their turn comes.
    assert {(x.ri, x.ai) for x in rec.matches.where("ri < 6").collect()} == {(k, k) for k in range(5)} | {(5, 5)}
