"""Every registered query against its reference SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL
from tests.oracle_check import compare, connect

#: Trains a hundred trees; the models with fewer trees are run here.
SLOW = {"train_measure"}
#: The operators on texts have tests of their own.
OWN = {n for n in entry.queries() if n in entry.LLM_QUERIES}


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and SLOW <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["station", "category", "n"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - SLOW - OWN))
def test_query(spark, con, name):
    problem, n = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SMALL)
    # No row of the smallest table has all five measures.
    assert not problem and (n > 0 or name == "dropna_any")
