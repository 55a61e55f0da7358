import hashlib
import random
import re

import pytest

from tabdelta.llm import components, exact_dedup, jaccard_join, suffix_dedup
from tabdelta.llm.shared import Workspace


def test_exact_dedup_through_many_levels(spark):
    rnd = random.Random(1)
    texts = [rnd.choice(["aa", "bb", "cc" * 50, "", None, "é", " aa"]) if rnd.random() < 0.6 else "t%d" % rnd.randint(0, 400) for _ in range(900)]
    rows = [(k, t, "x", k) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, __row int").repartition(3)
    want = {}
    for k, t in enumerate(texts):
        want.setdefault(t or "", []).append(k)
    for sizes in ({}, dict(window_bytes=300, table_bytes=1500, bucket_bytes=2000)):
        got = {r.doc_id: r for r in exact_dedup.exact_dedup(df, **sizes).collect()}
        assert len(got) == len(rows)
        for k, t in enumerate(texts):
            own = want[t or ""]
            assert (got[k].keep_id, got[k].group_size, got[k].kept) == (max(own), len(own), k == max(own))
            assert got[k].text_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_exact_dedup_keeps_one_of_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b")], "doc_id long, text string")
    rows = exact_dedup.exact_dedup(df).collect()
    assert sum(r.kept for r in rows) == 2 and {(r.text, r.keep_id, r.group_size) for r in rows} == {("a", 1, 3), ("b", None, 2)}
    assert sorted((r.doc_id is None, r.text) for r in exact_dedup.deduplicated(df).collect()) == [(False, "a"), (True, "b")]
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


def test_open_table_compares_content():
    t = exact_dedup.OpenTable()
    found = [t.find(b"x%d" % k, k % 3)[0] for k in range(3000)]
    assert len(set(found)) == 3000 and [t.find(b"x%d" % k, k % 3) for k in range(3000)] == [(e, False) for e in found]


def windows(texts, t):
    data = [(x or "").encode() for x in texts]
    seen = {}
    for b in data:
        for s in range(len(b) - t + 1):
            seen[b[s : s + t]] = seen.get(b[s : s + t], 0) + 1
    out = []
    for b in data:
        covered = [False] * len(b)
        for s in range(len(b) - t + 1):
            if seen[b[s : s + t]] > 1:
                covered[s : s + t] = [True] * t
        runs = [m.span() for m in re.finditer("1+", "".join("01"[x] for x in covered))]
        out.append((len(b), sum(covered), runs, bytes(y for y, x in zip(b, covered) if not x)))
    return out


@pytest.mark.parametrize("t,k,g", [(20, 6, 5), (24, 10, 2), (20, 5, 1000)])
def test_repeated_windows_equal_brute_force(spark, t, k, g, monkeypatch):
    rnd = random.Random(t + k + g)
    part = lambda n: "".join(rnd.choice("abcd é") for _ in range(n))
    passages = [part(rnd.randint(15, 80)) for _ in range(5)]
    texts = ["".join(rnd.choice([part(rnd.randint(1, 40)), rnd.choice(passages), rnd.choice(passages)[rnd.randint(0, 9) :]]) for _ in range(rnd.randint(0, 6))) for _ in range(60)]
    texts += [None, "", "a" * 300, "ab" * 200, texts[3], texts[3]]
    df = spark.createDataFrame([(i, x, "y") for i, x in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in suffix_dedup.suffix_dedup(df, threshold=t, digit=k, group_rows=g).collect()}
    assert got == dict(enumerate(windows(texts, t)))


def test_anchors_do_not_depend_on_pieces(monkeypatch):
    data = random.Random(3).randbytes(5000) + b"z" * 900
    whole = suffix_dedup.Anchors(60, 20).of(data)
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    parts = suffix_dedup.Anchors(60, 20).of(data)
    assert set(whole[0]) <= set(parts[0]) and set(parts[0]) <= set(whole[0])
    assert dict(zip(*map(list, whole))) == dict(zip(*map(list, parts)))


def test_nothing_to_remove(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.suffix_dedup(df).count() == 0


def shingle_sets(rows, w=5):
    out = []
    for _, t in rows:
        x = re.findall("[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")))
        out.append({tuple(x[i : i + w]) for i in range(len(x) - w + 1)} if len(x) >= w else ({tuple(x)} if x else set()))
    return out


def linked(rows):
    sets, parent = shingle_sets(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    return {d: (len(sets[i]), min(groups[root(i)])) for i, (d, _) in enumerate(rows)}


def near_copies(seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    base = [[rnd.choice(words) for _ in range(rnd.randint(3, 60))] for _ in range(15)]
    rows = []
    for i in range(160):
        b = list(rnd.choice(base[:4] if rnd.random() < 0.6 else base))
        for _ in range(rnd.randint(0, 3)):
            if b:
                k, kind = rnd.randrange(len(b)), rnd.random()
                b = b[:k] + ([rnd.choice(words)] if kind < 0.5 else []) + b[k + 1 :] if kind < 0.75 else [*b, rnd.choice(words)]
        rows.append((i * 3 + 1, " ".join(b)))
    return [*rows, (900, None), (901, ""), (902, " \n"), (903, "a B"), (904, "A b"), (905, "x"), (906, rows[0][1]), (907, rows[1][1].upper())]


@pytest.mark.parametrize("sizes", [{}, dict(cell_rows=5, small_cell=3, cell_pairs=2, sketch_bits=8)])
def test_jaccard_components_equal_brute_force(spark, sizes, monkeypatch):
    if sizes:
        monkeypatch.setattr(jaccard_join, "LOOKS", 3)  # further pivots are taken at once
    rows = near_copies(7)
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, component_id int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, **sizes).collect()}
    assert got == linked(rows)


def test_one_of_each_component_stays(spark):
    t = " ".join(f"w{k}" for k in range(40))
    rows = [(1, t), (2, t + " more"), (2, t + " more"), (3, "other words here"), (4, None), (5, None), (None, "other words here")]
    kept = jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text is None) for r in kept) == [(0, False), (1, False), (4, True), (5, True)]
    assert jaccard_join.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 130)]
    parent = {}
    root = lambda x: x if parent.setdefault(x, x) == x else root(parent[x])
    for u, v in edges:
        if u != v:
            a, b = sorted((root(u), root(v)))
            parent[b] = a
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "u long, v long"), Workspace(spark, "test"), "c").collect()}
    assert got == {x: root(x) for x in parent}
