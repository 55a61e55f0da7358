"""Ratios of many pairs against the matcher of single ones, and catalogue pairs against the rule."""

import random
from difflib import SequenceMatcher

import pytest

from tabdelta.functions.matching import ratios
from tabdelta.operators import catalogue
from tabdelta.operators.catalogue import pair_catalogues, unpaired, with_manual_pairs
from tabdelta.plans.pairing import pair_files
from tabdelta.queries import queries


def word(rnd, letters, longest):
    return "".join(rnd.choice(letters) for _ in range(rnd.randint(0, longest)))


def test_ratios_of_many_pairs():
    rnd = random.Random(2)
    pairs = [(word(rnd, letters, n), word(rnd, letters, n)) for letters, n in (("ab", 12), ("abcdé😀 _", 40), ("xyz", 260)) for _ in range(150)] + [("", ""), ("a", ""), ("", "a")]
    first, second = zip(*pairs)
    want = [SequenceMatcher(None, x, y).ratio() for x, y in pairs]
    assert ratios(first, second).tolist() == want
    for least in (0.5, 0.7, 0.85):
        assert [(r if r >= least else None) for r in ratios(first, second, least).tolist()] == [(w if w >= least else None) for w in want]


def by_rule(old, new, threshold, ignore_suffix=False):
    """pair_files over (id, name), with ids to tell equal names apart."""
    old, new = sorted(x for x in old if x[1] is not None), sorted(x for x in new if x[1] is not None)
    left, out = list(new), []
    for i, name in old:
        got = pair_files([name], [n for _, n in left], threshold, ignore_suffix)
        if got:
            k = [n for _, n in left].index(got[0].new)
            out.append((i, left.pop(k)[0], got[0].ratio))
    return sorted(out)


@pytest.mark.parametrize("threshold, ignore_suffix, giant", [(0.85, False, 10**6), (0.5, True, 10**6), (0.7, False, 20), (1.0, True, 10**6)])
def test_pairs_are_those_of_the_rule(spark, threshold, ignore_suffix, giant):
    rnd = random.Random(f"{threshold}")
    names = ["Report", "report_2023", "Sales Data", "sales-data", "Inventory", "", "über"]
    make = lambda n: [(i, rnd.choice(names) + word(rnd, "ab_1", 3) + rnd.choice([".xlsx", ".CSV", ""])) for i in rnd.sample(range(500), n)] + [(501, None)]
    old, new = make(45), make(40)
    o, n = (spark.createDataFrame(x, "id long, name string").repartition(3) for x in (old, new))
    assert sorted(map(tuple, pair_catalogues(o, n, threshold, ignore_suffix, giant).collect())) == by_rule(old, new, threshold, ignore_suffix)


def test_manual_pairs_unpaired_files_and_empty_catalogues(spark):
    o = spark.createDataFrame([(1, "sales.xlsx"), (2, "stock.xlsx"), (3, None)], "id long, name string")
    n = spark.createDataFrame([(7, "Sales.csv"), (8, "other.csv")], "id long, name string")
    auto = pair_catalogues(o, n)
    assert [tuple(x) for x in auto.collect()] == [(1, 7, 1.0)]
    both = with_manual_pairs(auto, spark.createDataFrame([(1, 8), (2, 8)], "old_id long, new_id long"))
    assert sorted(map(tuple, both.collect())) == [(1, 8, 1.0, "manual"), (2, 8, 1.0, "manual")]
    assert sorted((x.side, x.id) for x in unpaired(o, n, both).collect()) == [("new", 7), ("old", 3)]
    assert pair_catalogues(o.limit(0), n).count() == pair_catalogues(o, n.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pair_catalogues(o, n, 0.4)


def test_the_registered_query_over_a_table(spark):
    sf = "/root/testdata/sf0.001"
    urls = [(p.page_id, p.url) for p in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()]
    flat = lambda u: u.replace(".", "-").replace("/", "-")
    old, new = [(i, flat(u) + "_2023.xlsx") for i, u in urls], [(-i, flat(u).replace("example", "sample") + "_2024.csv") for i, u in urls]
    assert sorted(map(tuple, queries()["catalogue_pairs"](spark, sf).collect())) == by_rule(old, new, 0.85, True)


def test_names_that_are_all_alike_are_not_listed_in_pairs(spark, monkeypatch):
    listed, dealt = [], catalogue.dealt_entries
    monkeypatch.setattr(catalogue, "FEW", 0, raising=False)
    monkeypatch.setattr(catalogue, "dealt_entries", lambda r, a, pairs, *x, **y: listed.append(pairs.count()) or dealt(r, a, pairs, *x, **y))
    make = lambda sign: spark.createDataFrame([(sign * i, f"northern branch report {i * 101:04d} final.xlsx") for i in range(60)], "id long, name string")
    assert sorted(map(tuple, pair_catalogues(make(1), make(-1)).collect())) == [(i, -i, 1.0) for i in range(60)]
    assert max(listed) < 200  # of 3,600 pairs above the threshold


def test_searches_at_falling_ratios_find_the_pairs_of_the_rule(spark, monkeypatch):
    monkeypatch.setattr(catalogue, "FEW", 0, raising=False)
    rnd = random.Random(8)
    make = lambda n: [(i, rnd.choice(["report", "sales data", "repos", ""]) + word(rnd, "ab_1é😀", 4)) for i in rnd.sample(range(300), n)]
    old, new = make(40) + [(400, "report"), (401, "report")], make(30) + [(400, "report")]
    o, n = (spark.createDataFrame(x, "id long, name string") for x in (old, new))
    assert sorted(map(tuple, pair_catalogues(o, n, 0.6).collect())) == by_rule(old, new, 0.6)
