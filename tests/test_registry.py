import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_runs(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["request_id", "pool", "disposition", "source_type", "n_records"] and frame.count() > 0
