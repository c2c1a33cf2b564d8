"""Every registered query of the library against its DuckDB twin on the small tables."""

import pytest
from compare import duck, same

from loomgrid.plans import registry

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query_matches_sql(spark, con, name):
    assert same(registry.queries()[name](spark, SF), con, registry.oracles()[name]) > 0
