"""Every query of the engine against its SQL equivalent; the others have a brute-force test of their own."""

import pytest
from oracle import compare

from foliospark.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf, name):
    assert not compare(registry.queries()[name], SQL[name], spark, sf)


def test_names():
    assert set(SQL) <= set(registry.queries()) and registry.FLAGSHIP in SQL
    assert set(registry.queries()) - set(SQL) == {"grid_sizes"}  # test_operators.test_grid_sizes
