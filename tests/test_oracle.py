import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
import oracle  # noqa: E402

from skeinlake import queries  # noqa: E402


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_same_as_sql(spark, con, sf_dir, name):
    assert oracle.differences(spark, con, sf_dir, queries.QUERIES[name], queries.ORACLE_SQL[name]) == ""


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
