import __spark_entry__ as e


def test_queries_have_columns_and_sql(spark):
    known, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(known)
    assert e.entry(spark).columns == ["lang", "n_words", "n_letters"]
