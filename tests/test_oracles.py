import os

import pytest
from oracle import SMALL, differences

from lithoscope.plans import catalog


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the provided tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, SMALL)
    if name in catalog.ORACLES:
        assert differences(df, catalog.ORACLES[name]) == []
    else:
        assert df.count() > 0
