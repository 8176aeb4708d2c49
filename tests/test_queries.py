"""Every registered query of the ledger against its SQL on the smallest tables."""

import pytest

from tallywright.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, same_rows, name):
    df = QUERIES[name](spark, small)
    if name in SQL:
        same_rows(df, SQL[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 15
    assert set(e.oracle_sql()) <= set(e.queries())


def test_streamed_windows(spark, small):
    from tallywright.scratch import new_path
    from tallywright.streaming import ingest

    out = ingest.run_once(ingest.totals_by_time(ingest.read_stream(spark, small)), new_path(spark, "days"), new_path(spark, "state"))
    assert out.count() > 0
