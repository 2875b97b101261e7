"""Every registered query against its check SQL."""

import pytest

import __spark_entry__ as e
from check_oracle import compare, duck
from conftest import plan
from plumbline import catalog


@pytest.fixture(scope="module")
def con(folder):
    return duck(folder)


def has_keys(df):
    text = plan(df)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, folder, name):
    """Equal rows, from a plan without a join that lacks keys."""
    ok, text = compare(spark, con, name, folder, inspect=has_keys)
    assert ok, text


def test_every_check_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry(spark):
    df = e.entry(spark)
    assert df.columns == ["id", "target", "predicted", "score"]
    assert df.count() == 20
