import __spark_entry__ as entry


def test_queries_and_sql_fit():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 60 and {"p2_found", "semantic_rerank"} <= set(sql)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
