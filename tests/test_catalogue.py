"""Every catalogue query against its DuckDB oracle."""

from __future__ import annotations

import pytest

from quillon.plans import oracle, queries
from tests.compare import duck, same


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_query_has_an_oracle():
    assert set(queries.queries()) == set(oracle.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_matches_oracle(spark, sf_dir, con, name):
    same(queries.queries()[name](spark, sf_dir), con, oracle.oracle_sql()[name])


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
