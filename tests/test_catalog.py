"""Every registered query beside its SQL on the smallest tables; those without SQL give rows."""

import oracle
import pytest

from weftline.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.views(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert oracle.differences(df, ORACLES[name], con) == []
    else:
        assert df.count() > 0
