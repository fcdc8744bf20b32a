import __spark_entry__ as entry


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "line_no", "place", "start", "len", "term", "prob"] and df.limit(5).count() == 5
