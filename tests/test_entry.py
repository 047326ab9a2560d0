import __spark_entry__


def test_entry_and_registry(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and "flagship" in queries
    assert __spark_entry__.entry(spark).count() > 0
