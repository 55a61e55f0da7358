import random

import pytest

from tabdelta import queries
from tabdelta.operators import report
from tabdelta.operators.keyed import KEY, KeyedDiff
from tabdelta.operators.keyless import KeylessDiff
from tabdelta.operators.keys import choose_key
from tabdelta.operators.blocks import Reconciled
from tabdelta.operators.reconcile import assign, assign_in_order, candidate_pairs
from tabdelta.plans.compare import combined, compare_tables, compare_workbooks


def frame(spark, rows, columns):
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], ", ".join(f"{c} string" for c in columns) + ", __rid long")


def test_keyed_statuses_and_changed_columns(spark):
    old = frame(spark, [("1", "Ann", "Y"), ("2", "Bob", "N"), ("3", "Cy", "1.0"), ("4", "Di", None)], ["ID", "Name", "Active"])
    new = frame(spark, [("1.0", "ann", "TRUE"), ("2", "Rob", "0"), ("5", "Ed", "x"), ("4", "Di", "nan")], ["ID", "Name", "Active"])
    rows = {(r.status, r.key): r.changed_cols for r in KeyedDiff(old, new, ["ID"]).result().collect()}
    assert rows == {("changed", "2"): ["Name"], ("removed", "3"): [], ("added", "5"): []}


def test_first_of_duplicate_keys_is_compared_and_copies_counted(spark):
    old = frame(spark, [("a", "1"), ("a", "2"), ("b", "9")], ["k", "v"])
    new = frame(spark, [("a", "1"), ("a", "7"), ("c", "5"), ("c", "6")], ["k", "v"])
    d = KeyedDiff(old, new, ["k"])
    assert sorted((r.status, r.key) for r in d.result().collect()) == [("added", "C"), ("added", "C"), ("removed", "B")]
    assert {(r.key, r.n_old, r.n_new) for r in d.duplicate_keys().collect()} == {("A", 2, 2), ("C", 0, 2)}


def test_composite_keys_can_not_run_together(spark):
    old = frame(spark, [("a||b", "c", "1")], ["x", "y", "v"])
    new = frame(spark, [("a", "b||c", "1")], ["x", "y", "v"])
    assert {r.status for r in KeyedDiff(old, new, ["x", "y"]).result().collect()} == {"added", "removed"}


def test_diff_with_itself_is_empty_and_sides_swap(spark):
    rnd = random.Random(3)
    rows = lambda: [(str(rnd.randint(1, 30)), rnd.choice("abc"), rnd.choice(["1", "y", "2.50"])) for _ in range(60)]
    a, b = frame(spark, rows(), ["k", "v", "w"]), frame(spark, rows(), ["k", "v", "w"])
    assert KeyedDiff(a, a, ["k"]).result().isEmpty()
    kinds = lambda d, s: sorted(r.key for r in d.result().where(f"status = '{s}'").collect())
    ab, ba = KeyedDiff(a, b, ["k"]), KeyedDiff(b, a, ["k"])
    assert kinds(ab, "added") == kinds(ba, "removed") and kinds(ab, "changed") == kinds(ba, "changed")


def test_no_key_is_an_error(spark):
    old = frame(spark, [("1",)], ["k"])
    with pytest.raises(ValueError):
        KeyedDiff(old, old, ["nope"])


def test_keyless_modes(spark):
    old, new = frame(spark, [("A",), ("A",), ("B",)], ["v"]), frame(spark, [("A",), ("B",), ("B",)], ["v"])
    get = lambda mode: (sorted(r.row.v for r in KeylessDiff(old, new, mode).removed().collect()), sorted(r.row.v for r in KeylessDiff(old, new, mode).added().collect()))
    assert get("count") == (["A", "A"], ["B", "B"])
    assert get("exact") == (["A"], ["B"])
    assert get("set") == ([], [])


def test_one_empty_side_reports_all_rows(spark):
    old, new = frame(spark, [], ["v"]), frame(spark, [("A",), ("B",)], ["v"])
    assert KeylessDiff(old, new).added().count() == 2 and KeylessDiff(old, new).removed().count() == 0


def test_reconcile_candidates_equal_brute_force_and_rounds_equal_the_rule(spark):
    rnd = random.Random(5)
    cols = ["a", "b", "c", "d"]
    r = [(k, *[rnd.choice(["x", "y", "z", ""]) for _ in cols]) for k in range(25)]
    a = [(k, *[rnd.choice(["x", "y", "z", ""]) for _ in cols]) for k in range(20)]
    schema = ", ".join(f"{c} string" for c in cols)
    pairs = candidate_pairs(spark.createDataFrame(r, f"ri long, {schema}"), spark.createDataFrame(a, f"ai long, {schema}"), cols, 0.5)
    got = {(x.ri, x.ai): x.n_equal for x in pairs.collect()}
    want = {(x[0], y[0]): n for x in r for y in a if (n := sum(p == q for p, q in zip(x[1:], y[1:]))) >= 2}
    assert got == want
    assert sorted((x.ri, x.ai) for x in assign(pairs).collect()) == sorted(assign_in_order([(i, j, n) for (i, j), n in want.items()]))


def test_many_like_rows_are_assigned(spark):
    n = 300
    schema = "a string, b string, c string"
    rec = Reconciled(spark.createDataFrame([(k, "x", "y", "old") for k in range(n)], f"ri long, {schema}"), spark.createDataFrame([(k, "x", "y", "new") for k in range(n)], f"ai long, {schema}"), ["a", "b", "c"])
    assert sorted((r.ri, r.ai) for r in rec.matches.collect()) == [(k, k) for k in range(n)]


def test_groups_of_like_rows_follow_the_rule(spark):
    rnd = random.Random(11)
    for _ in range(2):
        likes = [[(a, rnd.randint(1, 3)) for a in rnd.sample(range(30), rnd.randint(1, 25))] for _ in range(5)]
        edges = [(r, a, n) for r in range(40) for a, n in likes[rnd.randrange(5)]]
        for few in (0, 1000):
            got = assign(spark.createDataFrame(edges, "ri long, ai long, n_equal int"), giant=few)
            assert sorted((x.ri, x.ai) for x in got.collect()) == sorted(assign_in_order(edges))


def test_reconcile_empty_side(spark):
    schema = "a string, b string"
    rec = Reconciled(spark.createDataFrame([], f"ri long, {schema}"), spark.createDataFrame([(1, "x", "y")], f"ai long, {schema}"), ["a", "b"])
    assert rec.changed().isEmpty() and rec.still_added().count() == 1


def test_key_choice(spark):
    old = spark.createDataFrame([("1", "a"), ("2", "a")], "emp_id string, kind string")
    new = spark.createDataFrame([("1", "b"), ("3", "b")], "emp_id string, kind string")
    assert choose_key(old, new, []) == ([], "No keys provided")
    assert choose_key(old, new, ["nothing"]) == ([], "No valid keys found")
    assert choose_key(old, new, ["kind", "Emp ID_1"]) == (["emp_id"], "Key: 'Emp ID_1' (100% unique)")
    twice = spark.createDataFrame([("1", "2")], "ID string, id_1 string")
    assert choose_key(twice, twice, ["id"])[0] == ["id_1"]


def test_truncation_bounds(spark):
    table = lambda n: spark.createDataFrame([(str(k),) for k in range(n)], "v string")
    flags = [report.truncation(table(a), table(b)).first().truncated for a, b in ((100, 90), (100, 91), (20, 15), (20, 16))]
    assert flags == [True, False, True, False]


def test_tables_without_key_are_reconciled(spark):
    old, new = frame(spark, [("1", "a", "b", "c"), ("2", "d", "e", "f")], ["p", "q", "r", "s"]), frame(spark, [("1", "a", "b", "X9"), ("7", "t", "u", "v")], ["p", "q", "r", "s"])
    res = compare_tables(old, new)
    got = {(r.status, r.old.p if r.old else None, r.new.p if r.new else None, tuple(r.changed_cols)) for r in res.diff.collect()}
    assert got == {("changed", "1", "1", ("s",)), ("removed", "2", None, ()), ("added", None, "7", ())}
    assert res.strategy == "keyless"


def test_workbooks(spark):
    t = lambda *rows: frame(spark, rows, ["ID", "v"])
    book = compare_workbooks({"B": t(("1", "a")), "A": t(("1", "a")), "old": t(("1", "a"))}, {"A": t(("1", "b")), "B": t(("1", "a")), "new": t(("1", "a"))}, "id")
    assert [s.sheet for s in book.sheets] == ["A", "B"] and book.only_old == ["old"] and book.only_new == ["new"]
    assert combined({"p": book}).select("sheet", "status").collect() == [("A", "changed")]
    assert [r.column for r in book.sheets[0].cells().collect()] == ["v"]
    assert book.sheets[0].summary().first().asDict() == {"n_changed": 1, "n_added": 0, "n_removed": 0}
    single = compare_workbooks({"x": t(("1", "a"))}, {"y": t(("1", "b"))}, "id")
    assert single.sheets[0].diff.count() == 1


def test_key_is_part_of_result(spark):
    old, new = frame(spark, [("k1", "a")], ["k", "v"]), frame(spark, [("k1", "b")], ["k", "v"])
    assert KEY in KeyedDiff(old, new, ["k"]).changed().columns


def test_comparable_names_reads_all_documents(spark, tmp_path):
    spark.createDataFrame([(1, "Web"), (400, "Books"), (9_003, "Books")], "doc_id long, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.name for r in queries.comparable_names(spark, str(tmp_path)).collect()}
    assert got == {"Web_1.XLSX", "Books_0.XLSX", "Books_3.XLSX"}


def test_reconcile_match_pairs_rows_with_half_of_their_cells(spark, tmp_path):
    spark.createDataFrame([(1, 7, "AUTO", 10.0), (2, 7, "AUTO", 999.0), (4, 8, "AUTO", 500.0)], "c_custkey long, c_nationkey int, c_mktsegment string, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    assert [tuple(r) for r in queries.reconcile_match(spark, str(tmp_path)).collect()] == [(2, 1)]


def test_reconcile_match_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    sides = [df.orderBy(df.columns[0]).collect() for df in queries._reconcile_sides(spark, sf)]
    like = lambda x, y: sum(str(x[c]).upper() == str(y[c]).upper() for c in queries._CELLS)
    taken, want = set(), []
    for r in sides[0]:
        best, at = 0, None
        for a in sides[1]:
            if a.ai not in taken and like(r, a) > best:
                best, at = like(r, a), a.ai
        if best >= 2:
            taken.add(at)
            want.append((r.ri, at))
    assert sorted(tuple(x) for x in queries.reconcile_match(spark, sf).collect()) == sorted(want)


def matching(a, b):
    """Characters in the longest common block, leftmost in a and then in b, and in what lies left and right of it."""
    best = (0, 0, 0)
    for i in range(len(a)):
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            if k > best[0]:
                best = (k, i, j)
    k, i, j = best
    return k and k + matching(a[:i], b[:j]) + matching(a[i + k :], b[j + k :])


def test_seq_similarity_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.p_partkey: r.ratio for r in queries.seq_similarity(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/part.parquet").collect():
        a, b = r.p_name.lower(), r.p_type.lower()
        assert got[r.p_partkey] == pytest.approx(2 * matching(a, b) / (len(a) + len(b)))


def test_ties_beyond_what_the_driver_takes(spark):
    n = 150
    edges = spark.range(n).selectExpr("id AS ri").join(spark.range(n).selectExpr("id AS ai", "2 AS n_equal"))
    assert sorted((r.ri, r.ai) for r in assign(edges, giant=1000).collect()) == [(k, k) for k in range(n)]
