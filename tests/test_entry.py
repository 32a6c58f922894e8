"""Driver contract: entry runs, every query has a callable, oracles name queries."""

import __spark_entry__ as entry


def test_entry_smoke(spark):
    frame = entry.entry(spark)
    assert frame.count() > 0
    assert {"phrase_hash", "peak_year", "peak_decade", "temporal_entropy"} <= set(frame.columns)


def test_oracles_refer_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.oracle_sql()) >= 40
