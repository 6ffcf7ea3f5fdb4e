import __spark_entry__


def test_every_sql_has_its_query():
    queries = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(queries)
    assert all(callable(f) for f in queries.values())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
