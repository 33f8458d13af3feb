"""Every query that SQL can express, against DuckDB on the smallest tables.

Model queries run with few, shallow trees and share their split rows here; what their SQL knows does not
depend on the size of the ensembles. ``check_all.py`` runs them as they are registered.
"""

from functools import cache

import pytest

from __spark_entry__ import SMOKE_DIR, entry, oracle_sql, queries
from gridcast.operators.forecasting.methods import smaller
from gridcast.plans import model_queries
from tests.oracle import connect, differences

SQL = oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SMOKE_DIR)


@pytest.fixture(scope="module", autouse=True)
def small_trials():
    with pytest.MonkeyPatch.context() as patch:
        for name in ("LOAD", "HOUR", "DAY"):
            patch.setattr(model_queries, name, smaller(getattr(model_queries, name), 8, 5))
        for name in ("_splits", "_day_splits"):
            patch.setattr(model_queries, name, _by_table(getattr(model_queries, name)))
        yield


def _by_table(make):
    shared = cache(lambda spark, sf: make(spark, sf))
    return lambda spark, sf, frame=None: shared(spark, sf) if frame is None else make(spark, sf, frame)


def test_oracle_keys_are_queries():
    assert set(SQL) <= set(queries())


def test_entry(spark):
    assert entry(spark).columns == ["date", "line"]


@pytest.mark.parametrize("key", sorted(SQL))
def test_query(spark, duck, key):
    assert differences(queries()[key](spark, SMOKE_DIR), duck, SQL[key]) == []
