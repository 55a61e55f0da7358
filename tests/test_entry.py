import __spark_entry__ as entry


def test_queries_and_oracles_agree_in_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "keyed_status_full" in entry.queries()


def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1
