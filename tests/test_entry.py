import __spark_entry__


def test_queries_and_sql_have_names_in_common(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert callable(__spark_entry__.entry)
