"""Every registered query against its SQL; those without SQL must at least return rows."""

import pytest
from compare import same
from conftest import SF

from streamscope.registry import QUERIES, SQL


def test_names():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in SQL:
        same(got, duck.execute(SQL[name]).fetchdf())
    else:
        assert len(got) > 0
