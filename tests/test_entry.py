import __spark_entry__ as entry


def test_contract(spark):
    assert entry.entry(spark).columns[0] == "doc_id"
    assert set(entry.oracle_sql()) <= set(entry.queries())
