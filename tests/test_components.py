"""Components against union-find, and the assignment by components against the rule."""

import random

from pyspark.sql import functions as F

from tabdelta.operators.components import components
from tabdelta.operators.reconcile import assign, assign_in_order


def roots(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def test_components_of_chains_stars_and_random_graphs(spark):
    rnd = random.Random(3)
    edges = [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(5001, 5100)] + [(rnd.randint(-300, 0), rnd.randint(-300, 0)) for _ in range(150)] + [(7, 7), (1000, 1001)]
    want = {n: r for n, r in roots([e for e in edges if e[0] != e[1]]).items()}
    got = components(spark.createDataFrame(edges, "u long, v long").repartition(3))
    assert {r.node: r.label for r in got.collect()} == want and got.count() == len(want)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_assignment_by_components_follows_the_rule(spark):
    rnd = random.Random(5)
    edges = list({(r, a): (r, a, n) for r, a, n in ((rnd.randint(-5, 200), rnd.randint(-9, 200), rnd.randint(1, 3)) for _ in range(260))}.values())
    got = assign(spark.createDataFrame(edges, "ri long, ai long, n_equal int").repartition(5))
    assert sorted(map(tuple, got.collect())) == sorted(assign_in_order(edges))


def test_a_million_tied_edges_in_one_component(spark):
    n = 1000
    edges = spark.range(n * n).select(F.floor(F.col("id") / n).alias("ri"), (F.col("id") % n).alias("ai"), F.lit(2).alias("n_equal"))
    got = assign(edges)
    assert "Collect" not in got._jdf.queryExecution().toString() and got.where("ri = ai").count() == got.count() == n
