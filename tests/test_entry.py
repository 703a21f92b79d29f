import __spark_entry__ as entry


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark, monkeypatch):
    assert "rrf_score" in entry.entry(spark).columns
