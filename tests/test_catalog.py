"""Every query of the catalogue against its SQL."""

import pytest
from conftest import SF, same_rows

from linkatlas import catalog


def test_each_query_has_sql():
    assert set(catalog.SQL) == set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    same_rows(catalog.QUERIES[name](spark, SF), duck.sql(catalog.SQL[name]))
