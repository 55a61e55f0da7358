from tabdelta.plans.batch import TableCache, compare_files, describe_files, propose_headers
from tabdelta.streaming.snapshots import diff_stream

from .test_sources import build


def test_files_to_results(spark, tmp_path):
    (tmp_path / "old").mkdir()
    (tmp_path / "new").mkdir()
    put = lambda name, text: (tmp_path / name).write_text(text)
    put("old/staff_2023.csv", "ID,Name\n1,Ann\n2,Bob\n3,Cy\n")
    put("new/staff_2024.csv", "id_1,NAME\n1,Ann\n2,Rob\n4,Di\n")
    put("old/alone.csv", "a,b\n1,2\n")
    build(str(tmp_path / "old/book.xlsx"))
    build(str(tmp_path / "new/book.xlsx"))
    put("old/broken1.xls", "no workbook")
    put("new/broken1.xls", "no workbook")
    old = [str(tmp_path / "old" / n) for n in ("staff_2023.csv", "alone.csv", "book.xlsx", "broken1.xls")]
    new = [str(tmp_path / "new" / n) for n in ("staff_2024.csv", "book.xlsx", "broken1.xls")]
    seen, cache = [], TableCache()
    got = compare_files(spark, old, new, "ID", cache=cache, progress=lambda a, b: seen.append((a, b)))
    assert got.unmatched_old == ["alone.csv"] and got.unmatched_new == [] and seen[-1] == (3, 3)
    assert list(got.errors) == ["broken1.xls / broken1.xls"]
    rows = {(r.status, r.key) for r in got.results["staff_2023.csv / staff_2024.csv"].sheets[0].diff.collect()}
    assert rows == {("changed", "2"), ("removed", "3"), ("added", "4")}
    assert got.summary(spark).first().asDict() == {"n_pairs": 2, "n_pairs_differ": 1, "identical": False}
    assert got.differences().count() == 3
    assert len(cache.known) >= 3
    cache.clear()
    assert propose_headers(spark, new[:2]) == {"staff_2024": 1, "Main": 2, "Gone": 2}
    assert describe_files(spark, str(tmp_path / "old" / "*.csv"), "old").select("sheet").orderBy("sheet").collect() == [("alone",), ("staff_2023",)]


def test_reading_options_and_rewritten_files(spark, tmp_path):
    (tmp_path / "old").mkdir()
    (tmp_path / "new").mkdir()
    build(str(tmp_path / "old/book.xlsx"))
    build(str(tmp_path / "new/book.xlsx"))
    got = compare_files(spark, [str(tmp_path / "old/book.xlsx")], [str(tmp_path / "new/book.xlsx")], "ID", sheets="visible", hidden_columns="keep", on_error="raise")
    assert not got.errors and [s.sheet for s in got.results["book.xlsx / book.xlsx"].sheets] == ["Main"]
    assert "Secret" in got.results["book.xlsx / book.xlsx"].sheets[0].columns
    old, new, cache = tmp_path / "old/t.csv", tmp_path / "new/t.csv", TableCache()
    old.write_text("ID,v\n1,a\n2,b\n")
    new.write_text("ID,v\n1,a\n2,c\n")
    count = lambda: compare_files(spark, [str(old)], [str(new)], "ID", cache=cache).differences().count()
    assert count() == 1
    new.write_text("ID,v\n1,x\n2,y\n3,z\n")
    assert count() == 3 and len(cache.known) == 2
    cache.clear()
    bad = compare_files(spark, [str(old)], [str(new)], "ID", header_overrides={"old": {"t": 0}})
    assert list(bad.errors) == ["t.csv / t.csv"]


def test_stream_of_batches(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("1", "a", 0), ("2", "x", 1), ("3", "c", 2)], "k string, v string, __rid long").write.parquet(src)
    reference = spark.createDataFrame([("1", "a", 0), ("2", "b", 1)], "k string, v string, __rid long")
    stream = spark.readStream.schema("k string, v string, __rid long").parquet(src)
    q = diff_stream(stream, reference, ["k"], out, str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert sorted((r.status, r.key) for r in spark.read.parquet(out).collect()) == [("added", "3"), ("changed", "2")]
