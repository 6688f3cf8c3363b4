"""Driver contract: entry() runs, every query has a callable, oracle keys are a subset."""

import __spark_entry__ as E


def test_entry_runs_with_stable_schema(spark):
    df = E.entry(spark)
    assert df.columns == E.entry(spark).columns
    assert df.count() >= 0


def test_oracle_keys_are_registered_queries():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 100
    assert all(callable(f) for f in q.values())
