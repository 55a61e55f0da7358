"""The WARC record table, the filter interaction audit and the source divergence audit against plain versions, with odd rows."""

import base64
import gzip
import hashlib
import re
from collections import Counter, defaultdict
from itertools import permutations
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tabdelta.llm import filter_audit, source_divergence, warc
from tabdelta.llm.shared import Workspace

ODD_TEXTS = [None, "", " \t\n", "one", "Ärger und Ünrat " * 120, "a b " * 300, "SHOUT all DAY " * 70, "x # y " * 150, " ".join(f"word{k}" for k in range(400)), " wide　blank " * 210, "\x00nul \x0b bell"]


def odd_documents(spark, n=200):
    rows = []
    for k in range(n):
        rows.append((k if k % 17 else None, ODD_TEXTS[k % len(ODD_TEXTS)] if k % 5 else f"own text {k} " * (k % 90), [None, "", "a", "b", "ünï"][k % 7 % 5], ["en", None, "de"][k % 3], k, "x", k % 2))
    rows += rows[3:9] + [(3, "another text of id 3", "a", "en", 0, "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, h long, part string, n int")


# -- filter interaction audit -------------------------------------------------------------------------------
def plain_audit(docs, labels):
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    least = {}
    for d, text, _ in docs:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    by_part = defaultdict(list)
    for d, text, part in docs:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": d is not None and d > least[text]}
        by_part[part or ""].append(({f for f in fails if fails[f]}, d in good, d in toxic))
    out = set()
    for part, rows in by_part.items():
        shapley = Counter()
        for order in permutations("ABCDE"):
            for fails, _, _ in rows:
                if hit := next((f for f in order if f in fails), None):
                    shapley[hit] += 1
        for order in permutations("ABCDE"):
            left = rows
            for k, f in enumerate(order):
                gone, left = [r for r in left if f in r[0]], [r for r in left if f not in r[0]]
                failing = [r for r in rows if f in r[0]]
                out.add((part, "".join(order), k + 1, len(left), len(gone), len(failing) - len(gone), sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone), shapley[f]))
    return out


AUDIT = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_filter_audit_equals_a_walk_through_every_order(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(k, k % 2, k % 3 % 2) for k in range(0, 150, 2)] + [(4, 1, 1), (4, None, 0), (None, 1, 1), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    got = filter_audit.filter_audit(docs, labels)
    assert got.columns == list(AUDIT)
    rows = [tuple(r) for r in got.collect()]
    want = plain_audit([(r.doc_id, r.text, r.source) for r in docs.collect()], [tuple(r) for r in labels.collect()])
    assert len(rows) == len(set(rows)) == 600 * 4 and set(rows) == want


def test_filter_audit_of_nothing_and_without_labels(spark):
    docs, labels = odd_documents(spark, 20), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(docs.limit(0), labels).count() == 0
    got = filter_audit.filter_audit(docs, labels)
    assert got.agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)
    assert got.where("step = 5").groupBy("part").agg(F.count_distinct("kept").alias("k")).where("k > 1").isEmpty()


def test_filter_audit_deals_no_words(spark):
    docs = odd_documents(spark)
    plan = filter_audit.word_totals(filter_audit._keyed(docs, "doc_id", "text", "source"))._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    assert physical.count("Exchange hashpartitioning") == 1  # texts alone; both word aggregates follow where they lie


# -- source divergence audit --------------------------------------------------------------------------------
def plain_divergence(docs, min_docs, top):
    words = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in docs]
    held, out = defaultdict(Counter), set()
    for lang, _, terms in words:
        held[lang].update(set(terms))
    for lang in {w[0] for w in words}:
        kept = {t for t, n in held[lang].items() if n >= min_docs}
        count = {s: Counter(t for a, b, ts in words if (a, b) == (lang, s) for t in ts if t in kept) for s in {w[1] for w in words if w[0] == lang}}
        whole = sum(count.values(), Counter())
        prob = lambda c, t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))
        for s, c in count.items():
            pairs = [(sum(abs(prob(c, t) - prob(o, t)) for t in kept), i) for i, o in count.items() if i != s]
            over = [(prob(c, t) - prob(whole, t), t) for t in kept if c[t] and prob(c, t) > prob(whole, t)]
            for part, found, most in (("pair", pairs, None), ("term", over, top)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


@pytest.mark.parametrize("min_docs, top", [(1, 3), (30, 50), (10**6, 50)])
def test_divergence_equals_plain_sums(spark, min_docs, top):
    docs = odd_documents(spark)
    got = source_divergence.divergence(docs, min_docs=min_docs, top=top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    rows = [tuple(r) for r in got.collect()]
    want = plain_divergence([(r.text, r.lang, r.source) for r in docs.collect()], min_docs, top)
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_divergence_of_nothing_and_of_one_source(spark):
    docs = odd_documents(spark)
    assert source_divergence.divergence(docs.limit(0)).count() == 0
    one = source_divergence.divergence(docs.withColumn("source", F.lit("s")), min_docs=1)
    assert one.where("part = 'pair'").isEmpty() and one.where("part = 'term'").isEmpty()  # a source that is its language


def test_divergence_is_exact_where_longs_overflow(spark):
    n, total = 10**15 + 7, 3 * 10**16 + 1
    got = spark.range(1).select(source_divergence.probability(F.lit(n), F.lit(total), F.lit(11)).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 5) // (total + 55)


# -- WARC ---------------------------------------------------------------------------------------------------
PAGES = [(5, "http://a/1", "same"), (2, "http://a/2", "same"), (9, None, "same"), (None, "http://a/4", "same"), (1, "http://a/ü x\r\nWARC-Type: evil", None), (7, "http://b", ""), (8, "http://c", "ä" * 5000), (3, "http://d", "WARC/1.1\r\n\r\n" * 50), (4, "http://e", "\r\n"), (None, "http://f", "only null"), (None, "http://f", "only null"), (6, "u", "\x00 € 😀"), (2, "http://a/2", "same")]


def pages_table(spark):
    return spark.createDataFrame([(*p, "x", 1, "clash") for p in PAGES], "page_id long, url string, html string, digest string, copies int, own string")


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def plain_records(min_bytes=0):
    first = {}
    for page, _, text in PAGES:
        if page is not None and len((text or "").encode()) >= min_bytes:
            first[text or ""] = min(page, first.get(text or "", page))
    rows = []
    for page, _, text in PAGES:
        least = first.get(text or "")
        revisits = least is not None and page != least
        rows.append((page, len((text or "").encode()), digest(text), "revisit" if revisits else "response", least if revisits else None))
    return sorted(rows, key=repr)


@pytest.mark.parametrize("size, min_bytes", [(warc.CHUNK, 0), (7, 0), (warc.CHUNK, 4)])
def test_round_trip_equals_plain_records(spark, size, min_bytes):
    got = warc.round_trip(pages_table(spark), size=size, min_bytes=min_bytes, archive_bytes=1500)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_records(min_bytes)


def test_hot_payloads_are_told_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "HOT_ROWS", 2)
    assert sorted(map(tuple, warc.round_trip(pages_table(spark)).collect()), key=repr) == plain_records()


def test_archives_hold_whole_records_that_others_can_read(spark, tmp_path):
    manifest = warc.archive_pages(pages_table(spark).repartition(2), folder=str(tmp_path / "out"), archive_bytes=600)
    assert manifest.agg(F.sum("n_records")).first()[0] == len(PAGES) and manifest.count() > 2
    bodies, ids = [], []
    for m in manifest.collect():
        data = gzip.decompress(Path(re.sub("^file:", "", m.archive)).read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
            n = int(fields[b"Content-Length"])
            assert head.startswith(b"WARC/1.1\r\n") and rest[n : n + 4] == b"\r\n\r\n"
            if fields[b"WARC-Type"] == b"response":
                body = rest[:n].partition(b"\r\n\r\n")[2]
                assert base64.b32encode(hashlib.sha1(body).digest()) == fields[b"WARC-Payload-Digest"].removeprefix(b"sha1:")
                bodies.append(body)
                ids.append(fields[b"WARC-Record-ID"])
            elif fields[b"WARC-Type"] == b"revisit":
                assert rest[:n].endswith(b"\r\n\r\n")
            data = rest[n + 4 :]
    want = {(p[2] or "").encode() for p in PAGES}
    assert set(bodies) == want
    chunks = warc.read_archives(spark, manifest, size=9)
    joined = chunks.where("record_type = 'response'").groupBy("archive", "record_id", "page_id").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "data"))).alias("c"), F.max("payload_bytes").alias("n"))
    assert {b"".join(bytes(x.data) for x in r.c) for r in joined.where("page_id IS NOT NULL").collect()} <= want
    revisits = {r.refers_to_id.encode() for r in chunks.where("record_type = 'revisit'").collect()}
    assert revisits <= set(ids)


def test_chunks_carry_running_digests(spark):
    text = "abcdefghij" * 10
    manifest = warc.archive_pages(spark.createDataFrame([(1, "u", text)], "page_id long, url string, html string"))
    rows = sorted(warc.read_archives(spark, manifest, size=30).collect(), key=lambda r: r.chunk_no)
    assert [r.payload_bytes for r in rows] == [30, 60, 90, 100] and [r.is_last for r in rows] == [False, False, False, True]
    assert [r.payload_digest for r in rows] == [digest(text[:n]) for n in (30, 60, 90, 100)]


def test_damage_is_an_error(spark, tmp_path):
    manifest = warc.archive_pages(spark.createDataFrame([(1, "u", "payload")], "page_id long, url string, html string"), folder=str(tmp_path / "w"))
    path = Path(re.sub("^file:", "", manifest.first().archive))
    path.write_bytes(gzip.compress(gzip.decompress(path.read_bytes()).replace(b"\r\n\r\npayload", b"\r\n\r\npaYload")))
    with pytest.raises(Exception, match="doesn't have its digest"):
        warc.read_archives(spark, manifest).collect()


def test_no_pages(spark):
    assert warc.round_trip(pages_table(spark).limit(0)).count() == 0


def test_unnamed_files_of_failed_tasks_are_not_read(spark, tmp_path):
    folder = tmp_path / "w"
    manifest = warc.archive_pages(spark.createDataFrame([(1, "u", "payload")], "page_id long, url string, html string"), folder=str(folder))
    (folder / "0123.warc.gz").write_bytes(b"half a file")
    assert warc.read_archives(spark, manifest).count() == 1


def test_records_reads_pages_once_more_for_equal_payloads_only(spark):
    rows = warc.records(pages_table(spark), Workspace(spark, "t"))
    assert {(r.page_id, r.record_type, bytes(r.payload)) for r in rows.where("record_type = 'revisit'").collect()} == {(5, "revisit", b""), (9, "revisit", b""), (None, "revisit", b""), (7, "revisit", b"")}
