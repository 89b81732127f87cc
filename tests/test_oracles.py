"""Every registered query against its oracle on the smallest data set."""

import os

import pytest
from compare import DATA, compare, oracle_connection, types_differ

from postlake.plans.registry import load_all

SF = os.path.join(DATA, "sf0.001")
QUERIES = load_all()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    q = QUERIES[name]
    df = q(spark, SF)
    if q.oracle is None:
        assert df.count() > 0
        return
    con = oracle_connection(SF)
    assert compare(df, con, q.oracle) is None
    assert types_differ(df, con, q.oracle) is None
