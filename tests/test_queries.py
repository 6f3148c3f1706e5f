"""Every registered core query against its oracle."""

import pytest
from compare import oracle, same

from ledgerflow.plans import queries as Q


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle(sf_dir)


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query(spark, sf_dir, con, name):
    df = Q.QUERIES[name](spark, sf_dir)
    same(df, con, Q.ORACLES[name]) if name in Q.ORACLES else df.collect()
