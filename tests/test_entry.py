"""The driver's contract, and a few queries on the smallest tables."""

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_every_query_is_callable_and_every_statement_has_a_query():
    found = entry.queries()
    assert len(found) >= 74 and all(map(callable, found.values()))
    assert set(entry.oracle_sql()) <= set(found)


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["tokenised_lengths", "class_balance", "dense_topk"])
def test_query_gives_rows(spark, name):
    assert entry.queries()[name](spark, SMALL).count() > 0
