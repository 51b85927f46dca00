"""Every query that SQL can express gives the rows of its SQL twin."""

import pytest
from twins import compare, connect

from wardlens.plans.catalog import COVERS, QUERIES, TWINS


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, sf_dir, con, name):
    assert compare(QUERIES[name](spark, sf_dir), con, TWINS[name]) is None


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_query_names_what_it_covers():
    assert all(COVERS[name] for name in QUERIES)
